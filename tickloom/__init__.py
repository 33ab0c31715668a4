"""tickloom: analytics over very many keyed, minute-level series, written for Spark."""

__version__ = "0.1.0"
