"""What the text operators share: the shared folder for intermediate tables, and reading of Arrow batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed pattern: words are what stands between these characters (space, and tab to carriage return).
WORD_GAP = "[\\x20\\x09-\\x0D]+"

_made: list[Scratch] = []
_open: list[Scratch] = []


class Scratch:
    """Intermediate tables that belong together: those made by written() while it is entered. release() deletes them and no others."""

    def __init__(self):
        self.tables: list[tuple[SparkSession, str]] = []
        _made.append(self)

    def __enter__(self) -> Scratch:
        _open.append(self)
        return self

    def __exit__(self, *_) -> None:
        _open.remove(self)

    def release(self) -> None:
        """Call it once results built on the tables are stored."""
        while self.tables:
            spark, path = self.tables.pop()
            try:
                hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
            except Exception:  # noqa: BLE001  the session may be gone at exit
                return


_rest = Scratch()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or, in local mode only, one of our own where that is unset (tests)."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where:
        return where
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tickloom-"))
    return spark.sparkContext.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts lineage, and survives the loss of executors.

    The table goes with the innermost Scratch that is entered, else when the process ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tickloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    (_open[-1] if _open else _rest).tables.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


atexit.register(lambda: [s.release() for s in _made])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of df has it (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def words_col(text: Column | str) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array laid end to end, and where each value starts (one entry more than values). Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """Cut a batch into runs of rows of about `most` bytes of text, so that working memory stays bounded. A longer text stands alone."""
    col = batch.column(batch.schema.get_field_index(column))
    if not len(col):
        return
    sizes = np.cumsum(np.asarray([0 if x is None else x for x in _lengths(col)], np.int64))
    start = 0
    while start < len(col):
        base = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, base + most, "right")))
        yield batch.slice(start, end - start)
        start = end


def _lengths(col: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
