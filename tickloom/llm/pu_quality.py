"""Quality scores learned from positive and unlabelled texts.

A linear scorer over statistics of the text minimises the non-negative unbiased risk
    prior * E_pos[l(z)] + max(0, E_all[l(-z)] - prior * E_pos[l(-z)]),    l(z) = log(1 + exp(-z)),
where E_pos runs over trusted positives and E_all over the whole unlabelled corpus. Both expectations, and the histogram from which
the class prior is estimated, are sums over all rows, gathered as one small matrix per partition; nothing is sampled, and the
number of passes over the table of statistics is fixed. The prior is the least ratio of unlabelled to positive mass above a score.

Null texts are taken as empty; an empty text has statistics of zero and gets the score that belongs to them. Without trusted
positives there is nothing to learn from: every score is then the neutral 0.5. Tied and repeated rows are scored alike; a score at the
threshold counts as positive. Very long texts are read whole, and an empty table gives an empty result. Columns besides id and text
are not read.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import slices, unused, utf8, written

STATS = ("log_words", "word_length", "upper", "digit", "symbol", "bang", "bar", "dot", "comma", "line", "other", "distinct", "repeat_next", "long_words", "short_words", "marked_ends")
#: Each statistic enters as its value, its square root and its square.
N_INPUTS = 3 * len(STATS) + 1
_CLASS = np.full(256, 9, np.uint8)
for _k, _chars in enumerate((bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b"#*$%&<>@^~{}[]=_\\/", b"!?", b"|", b".:;", b",", b"\n", b"")):
    _CLASS[list(_chars)] = _k
_CLASS[[32, 9, 11, 12, 13]] = 10
_CLASS[128:] = 11


def _stats(batch: pa.RecordBatch) -> np.ndarray:
    data, at = utf8(batch.column(1))
    classes = _CLASS[data]
    out = np.zeros((batch.num_rows, len(STATS)))
    for k, text in enumerate(batch.column(1).to_pylist()):
        words = text.split() if text else []
        if not words:
            continue
        n = len(words)
        c = np.bincount(classes[at[k] : at[k + 1]], minlength=12)
        chars = max(1, int(c.sum() - c[10] - c[8]))
        sizes = np.fromiter(map(len, words), np.int64, n)
        ends = sum(w[-1] in "#*$%&|!<>" for w in set(words)) / len(set(words))
        out[k] = (np.log1p(n) / 10, min(sizes.mean() / 20, 1), *(c[j] / chars for j in (0, 2, 3, 4, 5, 6, 7)), c[8] / n, c[11] / chars, len(set(words)) / n, sum(map(eq, words, words[1:])) / n, (sizes > 12).mean(), (sizes < 3).mean(), ends)
    return out


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: its id, text_key (a hash of the text) and the array `stats` (see STATS), computed over the whole text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches):
        for whole in batches:
            for batch in slices(whole, text_col):
                rows = _stats(batch)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), len(STATS)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), flat], names=["id", "text_key", "stats"])

    return docs.select(id_col, text_col, F.xxhash64(text_col).alias("_key")).mapInArrow(work, f"id {kind}, text_key bigint, stats array<double>")


def _inputs(stats: pa.Array) -> np.ndarray:
    x = np.asarray(stats.flatten()).reshape(-1, len(STATS))
    return np.concatenate([np.ones((len(x), 1)), x, np.sqrt(x), x * x], axis=1)


def _summed(df: DataFrame, function, size: int) -> np.ndarray:
    """Sum over all rows of function(inputs, trusted), a vector of `size`: added up in each task, then over tasks."""

    def work(batches):
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += function(_inputs(b.column(0)), np.asarray(b.column(1)).astype(bool))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total)], names=["i", "v"])

    out = np.zeros(size)
    for r in df.select("stats", "trusted").mapInArrow(work, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r.i] = r.v or 0.0
    return out


def _moments(w: np.ndarray, mean: np.ndarray, scale: np.ndarray):
    """Risk parts, gradients and curvatures of the two expectations at w."""
    d = len(w)

    def function(x, trusted):
        x = (x - mean) / scale
        x[:, 0] = 1
        z = np.clip(x @ w, -30, 30)
        s = 1 / (1 + np.exp(-z))
        curve = (x * (s * (1 - s))[:, None]).T @ x
        p = trusted
        return np.concatenate([[len(x), p.sum(), np.logaddexp(0, z).sum(), np.logaddexp(0, z[p]).sum()], x.T @ s, x[p].T @ s[p], x[p].sum(0), curve.ravel()])

    return function, 4 + 3 * d + d * d


def fit(rows: DataFrame, passes: int = 9, ridge: float = 1e-3) -> dict:
    """Weights from rows with `stats` and boolean `trusted` (a trusted positive; all rows count as unlabelled)."""
    d = N_INPUTS

    def first(x, trusted):
        return np.concatenate([[len(x), trusted.sum()], x.sum(0), (x * x).sum(0)])

    s = _summed(rows, first, 2 + 2 * d)
    model = {"mean": np.zeros(d), "scale": np.ones(d), "w": np.zeros(d), "prior": 0.5}
    if not s[0] or not s[1]:
        return model
    mean, scale = s[2 : 2 + d] / s[0], np.sqrt(np.maximum(s[2 + d :] / s[0] - (s[2 : 2 + d] / s[0]) ** 2, 0))
    scale[scale < 1e-9] = 1
    mean[0], scale[0] = 0, 1
    model |= {"mean": mean, "scale": scale}
    w = _descend(rows, np.zeros(d), mean, scale, 0.5, passes // 2, ridge)
    model["prior"] = prior = class_prior(rows, w, mean, scale)
    model["w"] = _descend(rows, w, mean, scale, prior, passes, ridge)
    return model


def _descend(rows, w, mean, scale, prior, passes, ridge):
    """Newton steps on the non-negative risk from w; a step that does not lower it is halved, and the point of least risk is returned. A pass is one evaluation."""
    d = len(w)
    penal = np.full(d, ridge)
    penal[0] = 0
    best, at, step = np.inf, w, np.zeros(d)
    for _ in range(passes):
        s = _summed(rows, *_moments(w, mean, scale))
        n, p = s[0], s[1]
        grad_all, grad_pos, sum_pos = s[4 : 4 + d] / n, s[4 + d : 4 + 2 * d] / p, s[4 + 2 * d : 4 + 3 * d] / p
        curve = s[4 + 3 * d :].reshape(d, d) / n
        negative_part = s[2] / n - prior * s[3] / p
        # l(z) = l(-z) - z, so the positive part is that of -z less the mean of z
        risk = prior * (s[3] / p - sum_pos @ w) + max(0.0, negative_part) + (penal * w * w).sum() / 2
        if risk >= best:
            step = step / 2
        else:
            best, at = risk, w
            # of prior * E_pos[l(z)]: prior * (E_pos[x s] - E_pos[x]); of the negative part, where it is above zero: E_all[x s] - prior * E_pos[x s]
            grad = prior * (grad_pos - sum_pos) + (grad_all - prior * grad_pos if negative_part >= 0 else 0) + penal * w
            step = np.linalg.solve(curve + np.diag(penal + 1e-4), grad)
            step = step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
        w = at - step
    return at


def class_prior(rows: DataFrame, w, mean, scale, bins: int = 512, least: float = 0.05) -> float:
    """Least ratio, over score thresholds that keep at least `least` of the positives, of unlabelled to positive mass above it."""

    def function(x, trusted):
        x = (x - mean) / scale
        x[:, 0] = 1
        k = np.minimum((bins / (1 + np.exp(-np.clip(x @ w, -30, 30)))).astype(int), bins - 1)
        return np.concatenate([np.bincount(k, minlength=bins), np.bincount(k[trusted], minlength=bins)]).astype(float)

    h = _summed(rows, function, 2 * bins)
    everything, positive = h[:bins][::-1].cumsum(), h[bins:][::-1].cumsum()
    n, p = everything[-1], positive[-1]
    keep = positive >= max(least * p, 1)
    slack = np.sqrt(np.log(20) / np.maximum(positive[keep], 1))
    ratio = (everything[keep] / n) / (positive[keep] / p) * (1 + slack)
    return float(min(0.99, max(0.02, ratio.min())))


def score_col(model: dict, stats: Column | str = "stats") -> Column:
    """The score as a plain expression over `stats`."""
    stats = F.col(stats) if isinstance(stats, str) else stats
    w = model["w"] / model["scale"]
    w[0] = model["w"][0]
    base = float(w[0] - (w[1:] * model["mean"][1:]).sum())
    n, z = len(STATS), F.lit(base)
    for k in range(n):
        x = stats[k]
        z = z + x * float(w[1 + k]) + F.sqrt(x) * float(w[1 + n + k]) + x * x * float(w[1 + 2 * n + k])
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))


def held_out_col(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def _scored(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """id, text_key, held_out and score for every row of docs."""
    held = lambda c: F.coalesce(held_out_col(c), F.lit(False))
    stats = written(statistics(docs, id_col, text_col), "pu-stats")
    trusted = labels.where(F.col(label_col) == 1).where(~held(id_col)).select(F.col(id_col).alias("_id")).distinct().withColumn("_t", F.lit(True))
    rows = stats.join(trusted, F.col("id") == F.col("_id"), "left").select("stats", F.coalesce("_t", F.lit(False)).alias("trusted"))
    model = fit(written(rows, "pu-rows"))
    return stats.select("id", "text_key", held("id").alias("held_out"), score_col(model).alias("score"))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, label_col: str = "quality") -> DataFrame:
    """id, held_out, score and predicted for every text. Positives are trusted from rows of `labels` that aren't held out; their other labels are not used."""
    scored = _scored(docs, labels, id_col, text_col, label_col)
    return scored.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, label_col: str = "quality") -> DataFrame:
    """The rows of docs whose score reaches the threshold; same columns. Rows are told apart by id and text."""
    i, t, key = (unused(docs, c) for c in ("_kept_id", "_kept_text", "_text_key"))
    kept = _scored(docs, labels, id_col, text_col, label_col).where(F.col("score") >= threshold).select(F.col("id").alias(i), F.col("text_key").alias(t)).distinct()
    return docs.withColumn(key, F.xxhash64(text_col)).join(kept, F.col(id_col).eqNullSafe(F.col(i)) & (F.col(key) == F.col(t)), "left_semi").drop(key)
