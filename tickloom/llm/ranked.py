"""Ranked lexical search: documents reordered by recursive graph bisection, clusters visited by their bounds until none can matter.

One pass over the texts keeps, for each document, its number of terms and how often it holds the terms that any item holds; all else
works on these small rows. A bisection tree, fitted on at most `sample` of them, routes every row to a leaf; leaves are dealt into
shards of about `shard_docs` documents, and each shard is reordered by a bisection of its own down to clusters of `cluster_docs`. The
index has a row per cluster: its postings with their impacts, and each term's greatest impact. The tree decides which documents stand
together, never which are found.

A cluster's bound for an item is the sum of its terms' weights times their greatest impacts. The item's best clusters are scored first,
which gives a score and an id to beat; then every cluster is visited in the order of its bound as long as the bound beats them, or
equals the score while the cluster holds a smaller id. So the result is that of scoring every document.

Terms are maximal runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower case; 64-bit hashes stand for them.
Null texts and texts without a term are no documents and never found. Rows of one item id are one item with the terms of all; an item
without terms has no rows. Scores tie by doc_id; a null id (and the largest long, which stands for it) comes last. Repeated rows of a
document are found each for itself. Texts of any length are read whole. Items whose terms pass `block_pairs` in all are searched in
blocks, each with its own pass. Other columns are not read; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm import bisection
from tickloom.llm.bisection import Rows
from tickloom.llm.common import slices, utf8, written
from tickloom.llm.textvec import _LOWER, span_hashes

#: Bytes of terms: digits, letters and all of UTF-8 beyond ASCII.
_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_NO_ID = (1 << 63) - 1
_INT = lambda raw: np.frombuffer(raw, "<i4").astype(np.int64)


def term_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each term, and each text's first term (one entry more than texts)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    data = _LOWER[data]
    term = _TERM[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    first, last = term.copy(), term.copy()
    first[1:] &= ~term[:-1] | edge[1:-1]
    last[:-1] &= ~term[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    out = span_hashes(data, starts, ends)
    for k in np.flatnonzero(ends - starts > 64):
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out, np.searchsorted(starts, at)


def _item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """Each item's different terms, as hashes."""

    def work(batches):
        for whole in batches:
            for batch in slices(whole, "t"):
                terms, first = term_hashes(*utf8(batch.column(1)))
                row = np.repeat(np.arange(batch.num_rows), np.diff(first))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(terms.view(np.int64))], names=["item", "term"])

    kind = items.schema[item_col].dataType.simpleString()
    return items.select(F.col(item_col).alias("item"), F.col(text_col).alias("t")).mapInArrow(work, f"item {kind}, term bigint").distinct()


def _vectors(docs: DataFrame, vocabulary: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """id, n (terms of the text), terms (numbers in the vocabulary, ascending) and tf (how often), of texts with a term; equal rows once, with their number."""

    def work(batches):
        for whole in batches:
            for batch in slices(whole, "t"):
                words, first = term_hashes(*utf8(batch.column(1)))
                n = np.diff(first)
                k = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
                hit = np.flatnonzero(vocabulary[k] == words)
                key, tf = np.unique(np.repeat(np.arange(len(n)), n)[hit] * len(vocabulary) + k[hit], return_counts=True)
                at = np.searchsorted(key, np.arange(len(n) + 1) * len(vocabulary))
                terms, tf = (key % len(vocabulary)).astype("<i4"), tf.astype("<i4")
                some = np.flatnonzero(n)
                cut = lambda v: pa.array([v[at[d] : at[d + 1]].tobytes() for d in some.tolist()], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), pa.array(n[some]), cut(terms), cut(tf)], names=["id", "n", "terms", "tf"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(work, "id bigint, n bigint, terms binary, tf binary")
    return rows.groupBy("id", "n", "terms", "tf").agg(F.count("*").alias("copies"))


def _rows_of(column: pa.Array) -> Rows:
    each = [np.frombuffer(x, "<i4") for x in column.to_pylist()]
    return Rows(np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64), np.concatenate([np.zeros(0, np.int64), *each]).astype(np.int64))


def _frequencies(vectors: DataFrame, n_terms: int) -> np.ndarray:
    """In how many documents each term of the vocabulary stands."""

    def work(batches):
        total = np.zeros(n_terms, np.int64)
        for b in batches:
            rows = _rows_of(b.column(0))
            total += np.bincount(rows.terms, np.repeat(b.column(1).to_numpy(), np.diff(rows.at)), n_terms).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "df"])

    df = np.zeros(n_terms, np.int64)
    for r in vectors.select("terms", "copies").mapInArrow(work, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect():  # as long as the vocabulary
        df[r.term] = r.df
    return df


def _tree(vectors: DataFrame, n: int, n_terms: int, sample: int, leaf: int) -> dict:
    """The bisection tree of about `sample` documents, in one task; what comes back is as long as the sample's terms at most."""
    share = min(1.0, 1.1 * sample / max(1, n))
    some = vectors.where(F.octet_length("terms") > 0).where(F.pmod(F.xxhash64("id", "terms"), F.lit(1 << 30)) < int(share * (1 << 30))).select("terms").limit(sample)

    def work(batches):
        batches = [b for b in batches if b.num_rows]
        if batches:
            column = pa.concat_arrays([b.column(0) for b in batches])
            for node, (terms, gain) in bisection.tree(_rows_of(column), n_terms, leaf).items():
                yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([terms.astype("<i4").tobytes()], pa.binary()), pa.array([gain.tobytes()], pa.binary())], names=["node", "terms", "gain"])

    return {r.node: (_INT(bytes(r.terms)), np.frombuffer(bytes(r.gain), float)) for r in some.coalesce(1).mapInArrow(work, "node bigint, terms binary, gain binary").collect()}


_CLUSTERS = "shard bigint, cluster int, ids array<bigint>, copies array<bigint>, at binary, terms binary, impacts binary, top_terms binary, top_impacts binary, least_id bigint"


def _clusters(batch: pa.Table, shard: int, n_docs: int, n_words: int, cluster_docs: int) -> pa.RecordBatch:
    """Index rows of one shard: its documents reordered and cut into clusters."""
    n = batch["n"].to_numpy()
    ids = batch["id"].fill_null(_NO_ID).to_numpy()
    rows = _rows_of(batch["terms"].combine_chunks())
    tf = _rows_of(batch["tf"].combine_chunks()).terms
    # 100 - 90 + (90 * n * N) div L, in Python's whole numbers, for no product may wrap
    m = np.array([100 - 90 + 90 * int(k) * n_docs // n_words for k in n], np.int64)
    impact = (1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, np.diff(rows.at)))
    place = bisection.order(rows, cluster_docs)
    # documents of equal content keep their places, the smallest ids in the first ones
    content = np.unique(np.array([hash((a, b, c)) for a, b, c in zip(batch["terms"].to_pylist(), batch["tf"].to_pylist(), n.tolist(), strict=True)], np.int64), return_inverse=True)[1]
    slots = np.argsort(content[place], kind="stable")
    place[slots] = np.lexsort((ids, content))
    out = []
    for c, lo in enumerate(range(0, len(place), cluster_docs)):
        docs = place[lo : lo + cluster_docs]
        own = rows.take(docs)
        imp = Rows(rows.at, impact).take(docs).terms
        by = np.argsort(own.terms, kind="stable")
        top, begin = np.unique(own.terms[by], return_index=True)
        best = np.maximum.reduceat(imp[by], begin) if len(begin) else imp
        raw = lambda v: v.astype("<i4").tobytes()
        out.append((shard, c, ids[docs].tolist(), batch["copies"].to_numpy()[docs].tolist(), raw(own.at), raw(own.terms), raw(imp), raw(top), raw(best), int(ids[docs].min())))
    kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.binary()] * 5, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _CLUSTERS.split(", ")])


def _index(vectors: DataFrame, nodes: dict, n_terms: int, n_docs: int, n_words: int, shard_docs: int, cluster_docs: int) -> DataFrame:
    """A row per cluster, of all documents that hold a term of the vocabulary."""

    def route(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bisection.routed(_rows_of(b.column(2)), nodes, n_terms))], names=[*b.schema.names, "leaf"])

    dealt = vectors.where(F.octet_length("terms") > 0).mapInArrow(route, "id bigint, n bigint, terms binary, tf binary, copies bigint, leaf bigint")
    sizes = {r.leaf: r.n for r in dealt.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # as many as the tree's leaves
    if not sizes:
        return vectors.sparkSession.createDataFrame([], _CLUSTERS)
    parts = F.create_map(*(F.lit(x) for leaf, n in sizes.items() for x in (leaf, -(-n // shard_docs))))
    shard = F.col("leaf") * (1 << 40) + F.pmod(F.xxhash64("id", "n", "terms", "tf"), parts[F.col("leaf")])

    def work(batches):
        held, last = [], None
        for b in batches:
            shards = b.column(6).to_numpy()
            cuts = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), len(shards)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi > lo:
                    if held and shards[lo] != last:
                        yield _clusters(pa.Table.from_batches(held), last, n_docs, n_words, cluster_docs)
                        held = []
                    last = int(shards[lo])
                    held.append(b.slice(lo, hi - lo))
        if held:
            yield _clusters(pa.Table.from_batches(held), last, n_docs, n_words, cluster_docs)

    return dealt.withColumn("shard", shard).repartition("shard").sortWithinPartitions("shard", "id").mapInArrow(work, _CLUSTERS)


class Search:
    """The items of a block: their terms, the terms' weights, and what a cluster's documents score."""

    def __init__(self, at: np.ndarray, terms: np.ndarray, weights: np.ndarray, top: int):
        self.at, self.terms, self.weights, self.top = at, terms, weights, top
        self.n = len(at) - 1

    def bounds(self, top_terms: list, top_impacts: list) -> np.ndarray:
        """Of each cluster (row) and item (column), the most that a document of it can score."""
        out = np.zeros((len(top_terms), self.n), np.int64)
        for c, (t, i) in enumerate(zip(top_terms, top_impacts, strict=True)):
            dense = np.zeros(len(self.weights), np.int64)
            t = _INT(t)
            dense[t] = _INT(i) * self.weights[t]
            out[c] = np.add.reduceat(dense[self.terms], self.at[:-1])
        return out

    def scores(self, item: int, at: np.ndarray, terms: np.ndarray, impacts: np.ndarray) -> np.ndarray:
        own = np.zeros(len(self.weights), np.int64)
        mine = self.terms[self.at[item] : self.at[item + 1]]
        own[mine] = self.weights[mine]
        total = np.concatenate([[0], np.cumsum(own[terms] * impacts)])
        return total[at[1:]] - total[at[:-1]]


class _Best:
    """The best documents of an item so far: score, id, copies."""

    def __init__(self, top: int, floor: tuple[int, int] | None):
        self.top, self.floor, self.found = top, floor, []

    def beats(self, bound: int, least_id: int) -> int:
        """1 if a cluster of this bound may hold something better, 0 if not because of its ids, -1 if because of its bound."""
        for score, name in [self.floor] * bool(self.floor) + ([self.found[-1][:2]] if len(self.found) == self.top else []):
            if bound < score:
                return -1
            if bound == score and least_id > name:
                return 0
        return 1

    def add(self, scores: np.ndarray, ids: np.ndarray, copies: np.ndarray) -> None:
        some = np.flatnonzero(scores > 0)
        some = some[np.lexsort((ids[some], -scores[some]))[: self.top]]
        self.found += [x for k in some.tolist() for x in [(int(scores[k]), int(ids[k]))] * min(int(copies[k]), self.top)]
        self.found = sorted(self.found, key=lambda f: (-f[0], f[1]))[: self.top]


def _visited(index: DataFrame, search: Search, floors: list, only: set | None) -> DataFrame:
    """Each item's best documents of each task's clusters: all clusters in the order of their bounds, or just those of `only` (item, shard, cluster)."""

    def work(batches):
        best = [_Best(search.top, floors[i]) for i in range(search.n)]
        for b in batches:
            if not b.num_rows:
                continue
            col = {n: b.column(n).to_pylist() for n in ("shard", "cluster", "ids", "copies", "at", "terms", "impacts", "top_terms", "top_impacts", "least_id")}
            bounds = search.bounds(col["top_terms"], col["top_impacts"])
            least = np.array(col["least_id"], np.int64)
            opened: dict[int, tuple] = {}
            for i in range(search.n):
                for c in np.lexsort((least, -bounds[:, i])).tolist():
                    bound = int(bounds[c, i])
                    if not bound:
                        break
                    if only is not None and (i, col["shard"][c], col["cluster"][c]) not in only:
                        continue
                    go = best[i].beats(bound, int(least[c]))
                    if go < 0:
                        break
                    if go:
                        if c not in opened:
                            opened[c] = _INT(col["at"][c]), _INT(col["terms"][c]), _INT(col["impacts"][c]), np.array(col["ids"][c], np.int64), np.array(col["copies"][c], np.int64)
                        at, terms, impacts, ids, copies = opened[c]
                        best[i].add(search.scores(i, at, terms, impacts), ids, copies)
        rows = [(i, *f) for i in range(search.n) for f in best[i].found]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["i", "score", "id"])

    found = index.mapInArrow(work, "i int, score bigint, id bigint")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= search.top)


def _probes(index: DataFrame, search: Search, each: int) -> set:
    """The clusters with each item's highest bounds: (item, shard, cluster), `each` for an item at most."""

    def work(batches):
        held: list[list] = [[] for _ in range(search.n)]
        for b in batches:
            if b.num_rows:
                bounds = search.bounds(b.column(2).to_pylist(), b.column(3).to_pylist())
                shard, cluster = b.column(0).to_numpy(), b.column(1).to_numpy()
                for i in range(search.n):
                    for c in np.argsort(-bounds[:, i], kind="stable")[:each].tolist():
                        if bounds[c, i]:
                            held[i].append((int(bounds[c, i]), int(shard[c]), int(cluster[c])))
                    held[i] = sorted(held[i], key=lambda x: (-x[0], x[1:]))[:each]
        rows = [(i, *h) for i in range(search.n) for h in held[i]]
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["i", "bound", "shard", "cluster"])

    found = index.select("shard", "cluster", "top_terms", "top_impacts").mapInArrow(work, "i int, bound bigint, shard bigint, cluster int")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("bound"), "shard", "cluster"))).where(F.col("rank") <= each)
    return {(r.i, r.shard, r.cluster) for r in found.collect()}


def rank_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", top: int = 10, sample: int = 16384, shard_docs: int = 16384, cluster_docs: int = 128, block_pairs: int = 1 << 18, probes: int = 4) -> DataFrame:
    """Each item's `top` documents with a score above 0: item, rank, id, score."""
    spark = docs.sparkSession
    kind = items.schema[item_col].dataType.simpleString()
    pairs = written(_item_terms(items, item_col, item_text_col), "search-items")
    blocks = max(1, -(-pairs.count() // block_pairs))
    out_schema = f"`{item_col}` {kind}, rank int, `{id_col}` bigint, score bigint"
    results = []
    for block in range(blocks):
        own = pairs.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).groupBy("item").agg(F.collect_set("term").alias("terms")).collect()  # about block_pairs terms
        if not own:
            continue
        vocabulary = np.unique(np.concatenate([np.array(r.terms, np.int64) for r in own]).view(np.uint64))
        vectors = written(_vectors(docs, vocabulary, id_col, text_col), "search-vectors")
        size = vectors.agg(F.sum("copies").alias("n"), F.sum(F.col("n") * F.col("copies")).alias("words")).first()
        n_docs, n_words = size.n or 0, size.words or 0
        if not n_docs:
            continue
        df = _frequencies(vectors, len(vocabulary))
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        nodes = _tree(vectors, n_docs, len(vocabulary), sample, max(1, sample // 64))
        index = written(_index(vectors, nodes, len(vocabulary), n_docs, n_words, shard_docs, cluster_docs), "search-index")
        terms = [np.searchsorted(vocabulary, np.array(r.terms, np.int64).view(np.uint64)) for r in own]
        search = Search(np.concatenate([[0], np.cumsum([len(t) for t in terms])]), np.concatenate(terms), weights, top)
        first = _probes(index, search, probes)
        near = spark.createDataFrame([(s, c) for s, c in {x[1:] for x in first}], "shard bigint, cluster int")
        beat: list = [None] * search.n
        for r in _visited(index.join(F.broadcast(near), ["shard", "cluster"], "left_semi"), search, beat, first).where(F.col("rank") == top).collect():  # at most one an item
            beat[r.i] = (r.score, r.id)
        names = spark.createDataFrame([(i, r.item) for i, r in enumerate(own)], f"i int, item {kind}")
        found = _visited(index, search, beat, None).join(F.broadcast(names), "i")
        results.append(found.select(F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.when(F.col("id") != _NO_ID, F.col("id")).alias(id_col), "score"))
    return reduce(DataFrame.unionByName, results) if results else spark.createDataFrame([], out_schema)
