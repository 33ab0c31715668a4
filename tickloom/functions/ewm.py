"""Exponentially weighted means, which no window aggregate expresses: vectorised passes over runs of whole tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.rolling import with_row


def with_ewm(s: DataFrame, wanted: dict[str, tuple[str, dict]]) -> DataFrame:
    """Adds columns name -> (source column, pandas ewm arguments such as {"span": 12, "adjust": True}). A name may be a later one's source. NaN becomes null.

    Tokens reach Python in order, many short ones in one batch; a task holds no more than a batch and the token that goes on in the next."""
    schema = T.StructType([*s.schema.fields, *(T.StructField(n, T.DoubleType()) for n in wanted)])
    rows = with_row(s.withColumns({f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in s.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}), "_at")

    def means(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        token = np.cumsum(table["_at"].to_numpy() == 0)
        table = table.drop_columns(["_at"])
        for name, (source, how) in wanted.items():
            x = pd.Series(table[source].cast(pa.float64()).to_numpy())
            table = table.append_column(name, pa.array(x.groupby(token).ewm(**how).mean().to_numpy(), pa.float64(), from_pandas=True))
        return table.to_batches()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in (x for x in batches if x.num_rows):
            starts = np.flatnonzero(b["_at"].to_numpy() == 0)
            if len(starts):
                whole = [x for x in (*held, b.slice(0, starts[-1])) if x.num_rows]
                yield from means(whole) if whole else ()
                held = []
                b = b.slice(starts[-1])
            held.append(b)
        yield from means(held) if held else ()

    return rows.mapInArrow(work, schema)
