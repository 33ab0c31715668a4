"""Line dedup by a suffix array over line ids. DataFrame functions only.

Every non-blank line becomes an id; ids that occur once can stand in no repeated run and cut the sequences of the others into
stretches. The suffixes of all stretches are ranked by prefix doubling: a rank is the place where the suffix's interval starts in
the suffix array, and ranks by the first 2^k lines come from pairs of ranks by the first 2^(k-1). Places are found from counts of
distinct pairs, summed within ranges and then over the ranges, so no task sees all suffixes or all followers of a common line.

Suffixes that share their first l lines form an interval whose longest common prefix is l or more. The run of l lines at a place
is named by the two ranks of 2^k lines that overlap on it, and the interval's first place in (id, line) order is the copy that
stays. A maximal repeated run counts if it has min_chars characters. Each of its lines lies in a shortest qualifying run that
starts or ends at some line of it, so those shortest runs, of both kinds, decide for all of them, and doubling stops at their length.

Null and empty texts have no lines. Blank lines are never deleted, nor do they part a run. Within one text later repeats of a run
go too. Rows that repeat both id and text count as one document, and each gets the same result; of rows with one id and different
texts, the order of hashes of the texts decides which comes first. An empty table gives an empty result. Columns besides id and
text pass through untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import unused, written

_GAPS = " \t\n\x0b\x0c\r"
_RANGES = 512


def _key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.xxhash64(F.col(text_col)))


def _starts(pairs: DataFrame, group: list[str], value: str, span: Column, first: Column) -> DataFrame:
    """`first` plus the sum of `c` over smaller values in the group: within ranges of the value, then over the ranges."""
    ranged = pairs.withColumn("_g", span)
    per = ranged.groupBy(*group, "_g").agg(F.sum("c").alias("_s"))
    whole = Window.partitionBy(*group).orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_before", F.coalesce(F.sum("_s").over(whole), F.lit(0))).select(*(F.col(g).alias(f"_{g}") for g in group), F.col("_g").alias("_g2"), "_before")
    inner = Window.partitionBy(*group, "_g").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    on = F.col("_g") == F.col("_g2")
    for g in group:
        on = on & (F.col(g) == F.col(f"_{g}"))
    out = ranged.withColumn("_in", F.coalesce(F.sum("c").over(inner), F.lit(0))).join(per, on)
    return out.withColumn("rank", first + F.col("_before") + F.col("_in"))


def _stretches(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Documents as arrays of lines, and the repeated lines with their rank as stretches of neighbours."""
    lines = F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda s, i: F.struct(F.xxhash64(s).alias("h"), F.when(F.translate(s, _GAPS, "") == "", 0).otherwise(F.length(s)).alias("len"), i.alias("pos")))
    compact = docs.select(F.col(id_col).alias("id"), _key(id_col, text_col).alias("d"), F.filter(lines, lambda x: x["len"] > 0).alias("lines"))
    compact = written(compact.groupBy("id", "d").agg(F.first("lines").alias("lines")), "line-docs")
    each = compact.select("id", "d", F.posexplode("lines").alias("seq", "x")).select("id", "d", "seq", "x.h", "x.len", "x.pos")
    counts = each.groupBy("h").agg(F.count("*").alias("c")).where("c > 1")
    ranked = _starts(counts, [], "h", F.shiftrightunsigned("h", 55), F.lit(0)).select(F.col("h").alias("h2"), F.col("rank").alias("r0"))
    live = each.join(ranked, F.col("h") == F.col("h2")).select("id", "d", "seq", "len", "pos", "r0")
    stretch = F.col("seq") - F.row_number().over(Window.partitionBy("d").orderBy("seq"))
    return compact, written(live.withColumn("part", stretch), "line-live")


def _doubled(live: DataFrame, k: int, total: int) -> DataFrame:
    """Adds r_k: the rank by the first 2^k lines, null where the stretch ends before or the block occurs once."""
    along = Window.partitionBy("d", "part").orderBy("seq")
    rows = live.withColumn("_next", F.lead(f"r{k - 1}", 1 << (k - 1)).over(along))
    pairs = rows.where(f"r{k - 1} is not null and _next is not null").groupBy(F.col(f"r{k - 1}").alias("a"), F.col("_next").alias("b")).agg(F.count("*").alias("c"))
    span = F.floor(F.col("b") * _RANGES / max(1, total))
    ranked = _starts(written(pairs, f"line-pairs-{k}"), ["a"], "b", span, F.col("a")).where("c > 1").select("a", "b", F.col("rank").alias(f"r{k}"))
    joined = rows.join(ranked, (F.col(f"r{k - 1}") == F.col("a")) & (F.col("_next") == F.col("b")), "left")
    return written(joined.drop("a", "b", "_next"), f"line-ranks-{k}")


def _shortest(live: DataFrame, min_chars: int) -> DataFrame:
    """Shortest qualifying runs: forward from each line, and backward from each line; columns d, start, n."""
    along = Window.partitionBy("d", "part").orderBy("seq")
    ahead = F.collect_list("len").over(along.rowsBetween(0, min_chars - 1))
    behind = F.reverse(F.collect_list("len").over(along.rowsBetween(1 - min_chars, 0)))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("sum"))
    grow = lambda acc, x: F.when(acc["sum"] >= min_chars, acc).otherwise(F.struct((acc["n"] + 1).alias("n"), (acc["sum"] + x).alias("sum")))
    needed = lambda lens: F.aggregate(lens, zero, grow, lambda acc: F.when(acc["sum"] >= min_chars, acc["n"]))
    rows = live.select("d", "seq", needed(ahead).alias("f"), needed(behind).alias("b"))
    runs = F.array(F.struct(F.col("seq").alias("start"), F.col("f").alias("n")), F.struct((F.col("seq") - F.col("b") + 1).alias("start"), F.col("b").alias("n")))
    return rows.select("d", F.inline(runs)).where("n is not null").distinct()


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 120) -> DataFrame:
    """id, d (key of id and text), n_lines (non-blank), removed (positions among all lines, sorted) for every document."""
    compact, live = _stretches(docs, id_col, text_col)
    runs = written(_shortest(live, min_chars), "line-runs")
    longest = runs.agg(F.max("n")).first()[0] or 1
    total = live.count()
    levels = longest.bit_length() - 1
    for k in range(1, levels + 1):
        live = _doubled(live, k, total)
    at = live.select("id", F.col("d").alias("d2"), "seq", F.array(*(f"r{k}" for k in range(levels + 1))).alias("r"))
    level = F.floor(F.log2(F.col("n").cast("double") + 0.5)).cast("int")
    head = runs.withColumn("k", level).join(at, (F.col("d") == F.col("d2")) & (F.col("start") == F.col("seq"))).select("id", "d", "start", "n", "k", F.get("r", F.col("k")).alias("ra")).where("ra is not null")
    tail = F.col("start") + F.col("n") - F.pow(F.lit(2.0), F.col("k")).cast("int")
    named = head.withColumn("_at", tail).join(at.drop("id"), (F.col("d") == F.col("d2")) & (F.col("_at") == F.col("seq"))).select("id", "d", "start", "n", "ra", F.get("r", F.col("k")).alias("rb")).where("rb is not null")
    named = written(named, "line-names")
    place = F.struct("id", "d", "start")
    first = named.groupBy("n", "ra", "rb").agg(F.count("*").alias("c"), F.min(place).alias("first")).where("c > 1")
    first = first.select(F.col("n").alias("n2"), F.col("ra").alias("ra2"), F.col("rb").alias("rb2"), F.col("first.d").alias("fd"), F.col("first.start").alias("fs"))
    later = named.join(first, (F.col("n") == F.col("n2")) & (F.col("ra") == F.col("ra2")) & (F.col("rb") == F.col("rb2"))).where("not (d = fd and start = fs)")
    gone = later.select("d", F.explode(F.sequence("start", F.expr("start + n - 1"))).alias("seq")).groupBy("d").agg(F.collect_set("seq").alias("gone")).withColumnRenamed("d", "d3")
    out = compact.join(gone, F.col("d") == F.col("d3"), "left")
    removed = F.sort_array(F.transform(F.coalesce("gone", F.expr("cast(array() as array<int>)")), lambda s: F.get("lines", s)["pos"]))
    return out.select("id", "d", F.size("lines").alias("n_lines"), removed.alias("removed"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 120, chars_col: str | None = None) -> DataFrame:
    """docs without the later copies of repeated runs; same columns. A document that loses all its lines goes; chars_col, if given, is counted anew."""
    key, other, gone, every = (unused(docs, f"_lr_{c}") for c in ("key", "d", "gone", "all"))
    found = repeated_lines(docs, id_col, text_col, min_chars).where("size(removed) > 0").select(F.col("d").alias(other), F.col("removed").alias(gone), (F.size("removed") == F.col("n_lines")).alias(every))
    rows = docs.withColumn(key, _key(id_col, text_col)).join(found, F.col(key) == F.col(other), "left").where(~F.coalesce(every, F.lit(False)))
    left = F.array_join(F.transform(F.filter(F.transform(F.split(F.col(text_col), "\n"), lambda s, i: F.struct(s.alias("s"), i.alias("i"))), lambda x: ~F.array_contains(gone, x["i"])), lambda x: x["s"]), "\n")
    rows = rows.withColumn(text_col, F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(left))
    if chars_col and chars_col in docs.columns:
        rows = rows.withColumn(chars_col, F.when(F.col(gone).isNull(), F.col(chars_col)).otherwise(F.length(text_col).cast(docs.schema[chars_col].dataType)))
    return rows.select(*(rows[f"`{c}`"] for c in docs.columns))
