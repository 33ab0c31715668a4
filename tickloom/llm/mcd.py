"""Quality rules with robust multivariate outliers. DataFrame functions only.

Statistics of each whole text are counted inside the JVM. Texts that fail the base rules go. For the rest, the vector of
transformed statistics is judged per language and source by the minimum covariance determinant: of all sets with a given share of a
group's rows, the one whose covariance has the least determinant gives centre and covariance, and a text goes if its Mahalanobis
distance is beyond a chi-square quantile. The search starts from six estimates (medians with median deviations; covariances of values
bounded by tanh, and of directions from the median; the half of the rows nearest to the median; two small random subsets). A
concentration step keeps the share of rows nearest to the centre and estimates anew from them, which never raises the determinant; after
two steps the two starts with the least determinants go on until it falls no more, and the lesser of them is taken. A step moves one
row of sums per group, start and task, and quantiles by a sketch of fixed size (exact up to 10,000 values, within a ten-thousandth of
the ranks beyond), so a group with a third of all rows is no burden to one task.

Null texts count as texts without words and fail the base rules. Null languages and sources form groups of their own. Tied
distances are kept together. A group with fewer than least_rows rows that pass the base rules, too few to estimate from, is judged
by estimates from all rows of its language, and where those are too few as well, from all rows, however few; so every row that passes
the base rules is judged. Repeated rows are judged alike. Very long texts are counted whole. An empty table gives an empty result.
Columns besides id, text, lang and source are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import words_col, written

_GAPS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
#: The transformed statistics, and the spread below which two values count as equal: it is added to the covariance's diagonal.
VECTOR = {"x0": 0.25, "x1": 0.10, "x2": 0.15, "x3": 0.10, "x4": 0.15}


#: Rows of a group that meet the group's estimates in one place; a larger group is split over as many places as that takes.
TOGETHER = 250_000
#: The pool of all rows; no group or language has this name.
_ALL = "\u0002"


def _beside(rows: DataFrame, groups: DataFrame, places: int, how: str = "inner", keys: tuple[str, ...] = ("grp",)) -> DataFrame:
    """Rows (with the keys and salt) joined with the rows that groups has for their keys."""
    copies = groups.withColumnsRenamed({k: f"_{k}" for k in keys}).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(places - 1))))
    on = F.pmod(F.col("salt"), F.lit(places)) == F.col("_salt")
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    return rows.join(copies, on, how).drop("_salt", *(f"_{k}" for k in keys))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(words: Column, window: int = 8) -> Column:
    """Words that stand in a run of `window` words found twice or more in the text."""

    def of_windows(hashes: Column) -> Column:
        n = F.size(hashes)

        def covered(order: Column) -> Column:
            h = lambda j: F.get(order, j)["h"]
            twice = F.filter(F.sequence(F.lit(0), F.size(order) - 1), lambda j: F.coalesce(h(j) == h(j - 1), F.lit(False)) | F.coalesce(h(j) == h(j + 1), F.lit(False)))
            starts = F.sort_array(F.transform(twice, lambda j: F.get(order, j)["i"]))
            start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end"))
            step = lambda acc, p: F.struct((acc["sum"] + F.lit(window) - F.greatest(F.lit(0), acc["end"] - p)).alias("sum"), (p + window).alias("end"))
            return F.aggregate(starts, start, step, lambda acc: acc["sum"])

        ordered = lambda: F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == n, F.lit(0)).otherwise(_let(ordered(), covered))

    hashed = lambda ids: F.transform(F.sequence(F.lit(1), F.size(ids) - (window - 1)), lambda i: F.xxhash64(F.slice(ids, i, window)))
    return F.when(F.size(words) < window, F.lit(0)).otherwise(_let(F.transform(words, lambda w: F.xxhash64(w)), lambda ids: _let(hashed(ids), of_windows)))


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every whole text, with the other columns asked for by the caller."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept_lines = F.filter(F.split(text, "\n"), lambda s: F.translate(s, _GAPS, "") != "")
    lines = _let(kept_lines, lambda a: F.size(a) - F.size(F.array_distinct(a)))
    counted = _let(words_col(text_col), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).cast("long").alias("n_repeat_words")))
    out = docs.withColumn("_c", counted).withColumns({"word_chars": F.length(F.translate(text, _GAPS, "")).cast("long"), "n_symbols": (F.length(text) - F.length(F.translate(text, _SYMBOLS, ""))).cast("long"), "n_dup_lines": lines.cast("long")})
    return out.withColumns({"n_words": F.col("_c.n_words"), "n_repeat_words": F.col("_c.n_repeat_words")}).drop("_c")


def chi2_cdf(x: float, k: int) -> float:
    """By the series of the lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, x = k / 2, x / 2
    term = total = 1 / a
    n = a
    while abs(term) > 1e-15 * abs(total):
        n += 1
        term *= x / n
        total += term
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def chi2_quantile(q: float, k: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < q else (lo, mid)
    return hi


def _distance(p: int) -> Column:
    """Squared Mahalanobis distance of x0.. from centre m0.. under the lower Cholesky factor l_i_j, by forward substitution."""
    y: list[Column] = []
    for i in range(p):
        rest = F.col(f"x{i}") - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}_{j}") * y[j]
        y.append(rest / F.col(f"l{i}_{i}"))
    out = y[0] * y[0]
    for v in y[1:]:
        out = out + v * v
    return out


def _factor(moments: DataFrame, p: int, consistency: float, floors: list[float]) -> DataFrame:
    """Centre and Cholesky factor per group, from sums s_i, q_i_j and the count c."""
    out = moments.withColumns({f"m{i}": F.col(f"s{i}") / F.col("c") for i in range(p)})
    for i in range(p):
        for j in range(i + 1):
            cov = (F.col(f"q{i}_{j}") / F.col("c") - F.col(f"m{i}") * F.col(f"m{j}")) * consistency
            if i == j:
                cov = F.greatest(cov, F.lit(0.0)) + floors[i] ** 2
            for k in range(j):
                cov = cov - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
            out = out.withColumn(f"l{i}_{j}", F.sqrt(F.greatest(cov, F.lit(1e-12))) if i == j else cov / F.col(f"l{j}_{j}"))
    determinant = math.prod((F.col(f"l{i}_{i}") * F.col(f"l{i}_{i}") for i in range(p)), start=F.lit(1.0))
    return out.select("grp", "start", determinant.alias("det"), *_estimates(p))


def _estimates(p: int) -> list[str]:
    return [*(f"m{i}" for i in range(p)), *(f"l{i}_{j}" for i in range(p) for j in range(i + 1))]


def _sums(xs: list[str]) -> list[Column]:
    p = len(xs)
    return [F.count("*").alias("c"), *(F.sum(x).alias(f"s{i}") for i, x in enumerate(xs)), *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}_{j}") for i in range(p) for j in range(i + 1))]


def _starts(rows: DataFrame, places: int, consistency: float, floors: list[float], small: int = 24) -> DataFrame:
    """The first estimates of each group, by start."""
    xs = list(VECTOR)
    p = len(xs)
    mid = written(rows.groupBy("grp").agg(F.count("*").alias("n"), *(F.percentile_approx(x, 0.5, 10_000).alias(f"m{i}") for i, x in enumerate(xs))), "mcd-mid")
    off = _beside(rows, mid.drop("n"), places).groupBy("grp").agg(*(F.percentile_approx(F.abs(F.col(x) - F.col(f"m{i}")), 0.5, 10_000).alias(f"d{i}") for i, x in enumerate(xs)))
    mid = written(mid.join(off, "grp").withColumns({f"d{i}": F.sqrt((F.col(f"d{i}") * 1.4826) ** 2 + floors[i] ** 2) for i in range(p)}), "mcd-spread")
    z = [(F.col(x) - F.col(f"m{i}")) / F.col(f"d{i}") for i, x in enumerate(xs)]
    far = _beside(rows, mid, places).withColumn("r", F.sqrt(sum((v * v for v in z[1:]), z[0] * z[0])))
    near = written(far.groupBy("grp").agg(F.percentile_approx("r", 0.5, 10_000).alias("half")), "mcd-half")
    far = _beside(far, near, places)
    moved = lambda start, v: F.struct(F.lit(start).alias("start"), *((F.col(f"m{i}") + F.col(f"d{i}") * u).alias(f"u{i}") for i, u in enumerate(v)))
    drawn = lambda seed: F.pmod(F.xxhash64("salt", F.lit(seed)), F.lit(1 << 30)) / (1 << 30) < small / F.col("n")
    made = [moved(1, [F.tanh(v) for v in z]), moved(2, [v / F.greatest(F.col("r"), F.lit(1e-9)) for v in z]), F.when(F.col("r") <= F.col("half"), moved(3, z)), F.when(drawn(1), moved(4, z)), F.when(drawn(2), moved(5, z))]
    each = far.select("grp", F.explode(F.array(*made)).alias("u")).where("u is not null").select("grp", "u.start", *(F.col(f"u.u{i}").alias(x) for i, x in enumerate(xs)))
    plain = mid.select("grp", F.lit(0).alias("start"), F.lit(None).cast("double").alias("det"), *(f"m{i}" for i in range(p)), *((F.col(f"d{i}") if i == j else F.lit(0.0)).alias(f"l{i}_{j}") for i in range(p) for j in range(i + 1)))
    return plain.unionByName(_factor(each.groupBy("grp", "start").agg(*_sums(xs)), p, consistency, floors))


def robust_estimates(rows: DataFrame, places: int = 1, share: float = 0.75, most_steps: int = 30) -> DataFrame:
    """Centre and Cholesky factor of each group `grp` of rows with columns salt, x0.., and the determinant.

    most_steps: steps after which the search ends though the determinant still falls by more than a ten-thousandth."""
    p, floors, xs = len(VECTOR), list(VECTOR.values()), list(VECTOR)
    quantile = chi2_quantile(share, p)
    consistency = share / chi2_cdf(quantile, p + 2)
    keys = ("grp", "start")

    def step(at: DataFrame, name: str) -> DataFrame:
        far = _beside(rows, at.drop("det"), places).select(*keys, "salt", *xs, _distance(p).alias("d2"))
        edge = written(far.groupBy(*keys).agg(F.percentile_approx("d2", share, 10_000).alias("edge")), f"{name}-edge")
        core = _beside(far, edge, places, keys=keys).where("d2 <= edge")
        return written(_factor(core.groupBy(*keys).agg(*_sums(xs)), p, consistency, floors), name)

    at = written(_starts(rows, places, consistency, floors), "mcd-starts")
    for k in range(2):
        at = step(at, f"mcd-{k}")
    order = Window.partitionBy("grp").orderBy("det", "start")
    done = at = written(at.withColumn("_k", F.row_number().over(order)).where("_k <= 2").drop("_k"), "mcd-best")
    for k in range(2, most_steps):
        new = step(at, f"mcd-{k}")
        both = new.join(at.select(F.col("grp").alias("g2"), F.col("start").alias("s2"), F.col("det").alias("before")), (F.col("grp") == F.col("g2")) & (F.col("start") == F.col("s2")))
        at = written(both.where("det < before * 0.9999").select(new.columns), f"mcd-on-{k}")
        if at.isEmpty():
            break
        done = done.unionByName(at)
    return done.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k", "start")


def _judges(passed: DataFrame, least_rows: int) -> DataFrame:
    """Per group of rows that pass the base rules: whose estimates judge it, its own, its language's or those of all rows."""
    groups = passed.groupBy("grp", "lang_pool").agg(F.count("*").alias("n"))
    langs = groups.groupBy("lang_pool").agg(F.sum("n").alias("n_lang"))
    judge = F.when(F.col("n") >= least_rows, F.col("grp")).when(F.col("n_lang") >= least_rows, F.col("lang_pool")).otherwise(F.lit(_ALL))
    return groups.join(langs, "lang_pool").select("grp", judge.alias("judge"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", share: float = 0.75, most_steps: int = 30, least_rows: int = 40, beyond: float = 1 - 1e-9) -> DataFrame:
    """id, the five statistics, base_failed, distance (squared; null where the base rules failed) and kept, for every row."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    group, pool = F.concat_ws("\u0000", part(lang_col), part(source_col)), F.concat(F.lit("\u0001"), part(lang_col))
    counted = text_statistics(docs.select(F.col(id_col), F.col(text_col), group.alias("grp"), pool.alias("lang_pool")), id_col, text_col).drop(text_col)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    vector = {"x0": F.log1p(n), "x1": F.log1p(F.col("word_chars") / n), "x2": F.asinh(10 * F.col("n_symbols") / n), "x3": F.sqrt(F.col("n_dup_lines") / n), "x4": F.sqrt(F.col("n_repeat_words") / n)}
    rows = written(counted.withColumn("base_failed", failed).withColumns(vector | {"salt": F.xxhash64(id_col, "n_words", "word_chars", F.monotonically_increasing_id())}), "mcd-rows")
    passed = rows.where(~F.col("base_failed"))
    judges = written(_judges(passed, least_rows), "mcd-judges")
    pools = F.explode(F.array("grp", "lang_pool", F.lit(_ALL))).alias("grp")
    used = judges.groupBy(F.col("judge").alias("grp")).agg(F.lit(1).alias("one"))
    places = max(1, -(-passed.count() // TOGETHER))
    pooled = written(_beside(passed.select("salt", *VECTOR, pools), used, places).drop("one"), "mcd-pools")
    at = written(robust_estimates(pooled, places, share, most_steps), "mcd-estimates")
    far = _beside(rows, judges.join(at.withColumnRenamed("grp", "judge"), "judge").drop("judge", "det"), places, "left")
    far = far.withColumn("distance", F.when(~F.col("base_failed"), _distance(len(VECTOR))))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= chi2_quantile(beyond, len(VECTOR)), F.lit(True))
    return far.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", kept.alias("kept"))
