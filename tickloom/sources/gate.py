"""The schema gate: which files of a directory hold a token's series, told by their footers, before anything is scanned.

Spark lists the files; tasks read each footer (a few kilobytes at a file's end) and give one row a file. Only the accepted files are
scanned. Stores that pyarrow can't open take the footer from the file's bytes, which Spark reads in the tasks."""

from __future__ import annotations

import io

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.rolling import KEY, PRICE, TIE, TIME
from tickloom.sources.series import FILE_SCHEMA

#: The columns that a token's file has, and no others.
COLUMNS = (TIME, PRICE)
_SHAPE = "path string, length bigint, columns array<string>, types array<string>, rows bigint, error string"


def _footer(source, path: str, length: int) -> tuple:
    import pyarrow.parquet as pq

    try:
        with pq.ParquetFile(source) as file:
            return path, length, file.schema_arrow.names, [str(t) for t in file.schema_arrow.types], file.metadata.num_rows, None
    except (pa.ArrowException, OSError, EOFError) as error:
        return path, length, None, None, None, f"{type(error).__name__}: {error}"[:300]


def footers(spark: SparkSession, directory: str, pattern: str = "*.parquet", whole_files: bool = False) -> DataFrame:
    """path, length, columns, types and rows of each file, or the error that its footer gives.

    Files of no bytes are not listed. whole_files: let Spark hand each file's bytes to the task, for stores that only Spark can read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(directory)

    def opened(batches):
        from pyarrow import fs

        for b in batches:
            rows = []
            for path, length in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    store, place = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file:///") else path)
                    with store.open_input_file(place) as source:
                        rows.append(_footer(source, path, length))
                except (pa.ArrowException, OSError) as error:
                    rows.append((path, length, None, None, None, f"{type(error).__name__}: {error}"[:300]))
            yield _batch(rows)

    def handed(batches):
        for b in batches:
            yield _batch([_footer(io.BytesIO(content), path, length) for path, length, content in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)])

    return files.select("path", "length", "content").mapInArrow(handed, _SHAPE) if whole_files else files.select("path", "length").mapInArrow(opened, _SHAPE)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 6
    kinds = (pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _SHAPE.split(", ")])


def judged(files: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """footers with `verdict`: accepted (exactly these columns, in any order), missing, extra, or broken."""
    wanted = F.array(*(F.lit(c) for c in columns))
    verdict = (
        F.when(F.col("error").isNotNull(), "broken").when(F.size(F.array_except(wanted, "columns")) > 0, "missing")
        .when(F.size("columns") != len(columns), "extra").otherwise("accepted")
    )
    return files.withColumn("verdict", verdict)


def gated_scan(spark: SparkSession, directory: str, columns: tuple[str, ...] = COLUMNS, **how) -> DataFrame:
    """The series of all accepted files, as read_directory gives them; files that are not accepted are not opened again.

    Spark takes the accepted paths as a list, as it keeps every scan's paths; a directory without one gives an empty series."""
    paths = [r.path for r in judged(footers(spark, directory, **how), columns).where("verdict = 'accepted'").select("path").toLocalIterator()]
    if not paths:
        return spark.createDataFrame([], f"{KEY} string, {TIME} timestamp, {TIE} long, {PRICE} double, category string")
    rows = spark.read.schema(FILE_SCHEMA).parquet(*paths)
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return rows.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.parquet$", "").alias(KEY), TIME, F.lit(0).cast("long").alias(TIE), PRICE, folder.alias("category"))
