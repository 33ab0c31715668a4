"""Benchmark decontamination: BM25 over an inverted index of test items, searched by block-max WAND with every passage of every text.

Texts are cut into overlapping passages of words, and items longer than a passage into pieces no longer than one; both go by their
item's id. A piece's score for a passage is its BM25 score divided by the score it gives to its own words, so one threshold serves
pieces of all lengths. A piece that stands in a text lies within two neighbouring passages, so one of them holds half its score. Before the search, all passages of a batch get an upper bound at once: the weights
of rare terms are added up per passage and item, and common terms count in full for every item. Only passages whose bound reaches
the threshold are searched, so none above it is lost. What is retrieved is then verified: the item's question and its answer
must both be found, whole, as word n-grams near the passage.

The index is built in shards of about shard_bytes of item text, and every shard meets every passage; a shard's findings are stored
before the next is fetched, so memory does not grow with the number of items. Document frequencies, the number of items and the mean
length are those of all items, whatever the shards. Null and empty texts and items match nothing; items without a word are skipped;
repeated items are reported each for itself, and repeated rows too. A score at the threshold is retrieved; of passages with tied scores
the first counts. Very long texts are cut like others, and an empty table on either side gives an empty result. Columns besides id and
text are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tickloom.llm.common import slices, unused, utf8, written
from tickloom.llm.textvec import plain, word_hashes

K1, B = 1.2, 0.75
BLOCK = 32
#: Postings that are added up at once for the bound; a single window may have more.
POSTINGS = 1 << 17


class ItemIndex:
    """Postings of one shard of items, with block maxima, and the parts that the bound needs. Items of more than piece_words words stand in several pieces.

    ids, parts and sizes (in words) are by item; words, owner (the piece's item) and the postings are by piece."""

    def __init__(self, items: list[tuple], threshold: float, gram: int = 3, piece_words: int = 64, whole: tuple | None = None):
        """whole: number of items, mean words of a piece, and each term's number of items, over all shards; by default those of these items."""
        self.threshold, self.gram = threshold, gram
        self.ids, self.parts, self.sizes, self.words, self.owner = [], [], [], [], []
        df: Counter = Counter()
        for item_id, text in items:
            question, answer = split_item(text or "")
            words = _hashes(text or "")
            if len(words):
                pieces = np.array_split(words, -(-len(words) // piece_words))
                self.words += pieces
                self.owner += [len(self.ids)] * len(pieces)
                self.ids.append(item_id)
                self.sizes.append(len(words))
                df.update(set(words.tolist()))
                self.parts.append((self._grams(_hashes(question)), self._grams(_hashes(answer))))
        counts = [Counter(w.tolist()) for w in self.words]
        n, mean, df = whole or (len(self.ids), max(1.0, float(np.mean([len(w) for w in self.words])) if self.words else 1.0), df)
        postings: dict[int, list] = {}
        for d, c in enumerate(counts):
            length = sum(c.values())
            raw = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean)) for t, tf in c.items()}
            total = sum(raw.values())
            for t, w in raw.items():
                postings.setdefault(t, []).append((d, w / total))
        self.lists = {t: ([d for d, _ in p], [w for _, w in p], [max(w for _, w in p[k : k + BLOCK]) for k in range(0, len(p), BLOCK)], max(w for _, w in p)) for t, p in postings.items()}
        # the most common terms count in full for each item, as long as they alone reach no more than half the threshold
        common, rest = np.zeros(max(1, len(counts))), []
        for t in sorted(self.lists, key=lambda t: (-len(self.lists[t][0]), t)):
            docs, weights, _, _ = self.lists[t]
            if not rest and (common[docs] + weights).max() <= threshold / 2:
                common[docs] += weights
            else:
                rest.append(t)
        rest.sort()
        self.common = common
        self.rare = np.array(rest, np.uint64)
        sizes = [len(self.lists[t][0]) for t in rest]
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.post_item = np.array([d for t in rest for d in self.lists[t][0]], np.int64)
        self.post_weight = np.array([w for t in rest for w in self.lists[t][1]])

    def _grams(self, words: np.ndarray) -> set:
        w = words.tolist()
        g = min(self.gram, len(w))
        return {tuple(w[k : k + g]) for k in range(len(w) - g + 1)} if g else set()

    def hopeful(self, words: np.ndarray, window: np.ndarray, step_back: np.ndarray) -> np.ndarray:
        """Windows whose bound reaches the threshold. window: that each word starts a half of; step_back: whether the one before has it too.

        Windows rise with the words. Postings are laid out for as many windows at a time as have about POSTINGS of them."""
        if not len(self.rare) or not len(words):
            return np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(self.rare, words), len(self.rare) - 1)
        hit = np.flatnonzero(self.rare[k] == words)
        k, win, back = k[hit], window[hit], step_back[hit]
        if not len(win):
            return np.zeros(0, np.int64)
        before = np.concatenate([[0], np.cumsum(self.first[k + 1] - self.first[k])])
        out, edge = [], int(win[0]) - 1
        while (lo := int(np.searchsorted(win, edge))) < len(win):
            edge = max(edge, int(win[lo]) - 1)
            full = int(np.searchsorted(before, before[lo] + POSTINGS, "right")) - 1  # hits before this one have no more postings than that
            stop = max(edge + 1, int(win[full]) - 1) if full < len(win) else int(win[-1]) + 1
            own, both = int(np.searchsorted(win, stop)), int(np.searchsorted(win, stop + 1))
            later = lo + np.flatnonzero(back[lo:both] & (win[lo:both] > edge))
            out.append(self._over(np.concatenate([k[lo:own], k[later]]), np.concatenate([win[lo:own], win[later] - 1])))
            edge = stop
        return np.concatenate(out)

    def _over(self, k: np.ndarray, win: np.ndarray) -> np.ndarray:
        """Windows whose bound reaches the threshold, of those to which these hits (places of rare terms) belong."""
        n = self.first[k + 1] - self.first[k]
        at = np.repeat(self.first[k] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        item = self.post_item[at]
        key = np.repeat(win, n) * len(self.common) + item
        order = np.argsort(key, kind="stable")
        key, weight = key[order], self.post_weight[at][order]
        if not len(key):
            return np.zeros(0, np.int64)
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sums = np.add.reduceat(weight, starts)
        key = key[starts]
        return np.unique(key[sums + self.common[key % len(self.common)] >= self.threshold - 1e-9] // len(self.common))

    def search(self, passage: list[int]) -> list[tuple[int, float]]:
        """Block-max WAND: every piece whose score for the passage's terms reaches the threshold."""
        cursors = [[self.lists[t], 0] for t in set(passage) if t in self.lists]
        out, least = [], self.threshold - 1e-9
        while cursors:
            cursors.sort(key=lambda c: c[0][0][c[1]])
            bound, pivot = 0.0, None
            for j, (lst, _) in enumerate(cursors):
                bound += lst[3]
                if bound >= least:
                    pivot = j
                    break
            if pivot is None:
                break
            item = cursors[pivot][0][0][cursors[pivot][1]]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0][0][cursors[pivot + 1][1]] == item:
                pivot += 1
            blocks, edge = 0.0, None
            for c in cursors[: pivot + 1]:
                p = self._seek(c[0][0], c[1], item)
                if p < len(c[0][0]):
                    blocks += c[0][2][p // BLOCK]
                    end = c[0][0][min(len(c[0][0]), (p // BLOCK + 1) * BLOCK) - 1]
                    edge = end if edge is None else min(edge, end)
            if blocks >= least:
                score = 0.0
                for c in cursors[: pivot + 1]:
                    c[1] = self._seek(c[0][0], c[1], item)
                    if c[1] < len(c[0][0]) and c[0][0][c[1]] == item:
                        score += c[0][1][c[1]]
                        c[1] += 1
                if score >= least:
                    out.append((item, score))
            else:  # no item up to the end of the shortest block can reach it
                onward = item + 1 if edge is None else edge + 1
                if pivot + 1 < len(cursors):
                    onward = min(onward, cursors[pivot + 1][0][0][cursors[pivot + 1][1]])
                for c in cursors[: pivot + 1]:
                    c[1] = self._seek(c[0][0], c[1], max(onward, item + 1))
            cursors = [c for c in cursors if c[1] < len(c[0][0])]
        return out

    @staticmethod
    def _seek(docs: list[int], at: int, item: int) -> int:
        from bisect import bisect_left

        return bisect_left(docs, item, at)

    def verify(self, item: int, words: list[int]) -> tuple[float, float]:
        """Share of the question's and of the answer's n-grams among these words."""
        shares = []
        for grams in self.parts[item]:
            g = len(next(iter(grams))) if grams else 0
            there = {tuple(words[k : k + g]) for k in range(len(words) - g + 1)} if g else set()
            shares.append(len(grams & there) / len(grams) if grams else 1.0)
        return shares[0], shares[1]


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: all sentences but the last, and the last; of a single sentence, its first two thirds of words and the rest."""
    sentences = [s for s in re.split(r"(?<=[.!?:])\s+|\n+", text) if s.strip()]
    if len(sentences) > 1:
        return " ".join(sentences[:-1]), sentences[-1]
    words = text.split()
    cut = (2 * len(words) + 2) // 3
    return " ".join(words[:cut]), " ".join(words[cut:])


def _hashes(text: str) -> np.ndarray:
    data, at = utf8(pa.array([text]))
    return word_hashes(plain(data), at)[0]


def _contaminated(index: ItemIndex, words: np.ndarray, first: np.ndarray, half: int, least: float):
    """(row, item, score, question share, answer share) of the texts whose words these are; the best score of each pair."""
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(words)) - first[:-1][row] if len(words) else np.zeros(0, np.int64)
    halves = np.maximum(1, -(-n // half))
    base = np.concatenate([[0], np.cumsum(halves)])
    window = base[row] + inside // half
    best: dict[tuple[int, int], tuple] = {}
    for win in index.hopeful(words, window, inside >= half).tolist():
        r = int(np.searchsorted(base, win, "right")) - 1
        lo = int(first[r]) + (win - int(base[r])) * half
        hi = min(lo + 2 * half, int(first[r + 1]))
        for piece, score in index.search(words[lo:hi].tolist()):
            item = index.owner[piece]
            if best.get((r, item), (0,))[0] >= score:
                continue
            reach = index.sizes[item]
            q, a = index.verify(item, words[max(int(first[r]), lo - reach) : min(int(first[r + 1]), hi + reach)].tolist())
            if q >= least and a >= least:
                best[r, item] = (score, q, a)
    return [(r, item, *found) for (r, item), found in best.items()]


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", passage_words: int = 64, threshold: float = 0.4, least_overlap: float = 0.5, shard_bytes: int = 16 << 20) -> DataFrame:
    """One row per text and test item found in it: id, item id, score (share of the BM25 score that the item, or its best piece, gives to itself), question_overlap, answer_overlap."""
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    names = [id_col, f"found_{item_col}" if item_col.lower() == id_col.lower() else item_col, "score", "question_overlap", "answer_overlap"]
    schema = f"`{names[0]}` {kind}, `{names[1]}` {item_kind}, score double, question_overlap double, answer_overlap double"
    items = items.select(F.col(item_col).alias("i"), F.col(item_text_col).alias("t"))
    total = items.agg(F.sum(F.coalesce(F.octet_length("t"), F.lit(0)) + 16)).first()[0] or 0
    shards = max(1, -(-int(total) // shard_bytes))
    piece_words = max(1, passage_words // 2 * 2)
    id_type, item_type = to_arrow_type(docs.schema[id_col].dataType), to_arrow_type(items.schema["i"].dataType)

    def found_in(shard: list[tuple], whole: tuple | None) -> DataFrame:
        def work(batches):
            index = ItemIndex(shard, threshold, piece_words=piece_words, whole=whole)
            for rows in batches:
                for batch in slices(rows, text_col):
                    data, at = utf8(batch.column(1))
                    words, first, _ = word_hashes(plain(data), at)
                    found = _contaminated(index, words, first, passage_words // 2, least_overlap)
                    ids = batch.column(0).take(pa.array([f[0] for f in found], pa.int64())).cast(id_type)
                    yield pa.RecordBatch.from_arrays([ids, pa.array([index.ids[f[1]] for f in found], item_type), *(pa.array([f[j] for f in found], pa.float64()) for j in (2, 3, 4))], names=names)

        return docs.select(id_col, text_col).mapInArrow(work, schema)

    if shards == 1:
        return found_in([(r.i, r.t) for r in items.collect()], None)
    items = items.withColumn("shard", F.pmod(F.xxhash64("i", "t"), F.lit(shards)))
    terms = written(_terms(items, piece_words), "leak-terms")
    sizes = terms.agg(F.count("*").alias("n"), F.sum("words").alias("words"), F.sum("pieces").alias("pieces")).first()
    often = written(terms.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")), "leak-often")
    parts = []
    for k in range(shards):
        own = terms.where(F.col("shard") == k).select(F.explode("terms").alias("term")).distinct()
        df = {r.term % (1 << 64): r.df for r in own.join(often, "term").collect()}
        whole = (sizes.n, max(1.0, (sizes.words or 0) / max(1, sizes.pieces or 0)), df)
        parts.append(written(found_in([(r.i, r.t) for r in items.where(F.col("shard") == k).collect()], whole), f"leaks-{k}"))
    return reduce(DataFrame.unionByName, parts)


def _terms(items: DataFrame, piece_words: int) -> DataFrame:
    """Per item with words: its shard, different terms, and numbers of words and pieces."""

    def work(batches):
        for b in batches:
            each = [(shard, _hashes(t)) for shard, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t]
            each = [(shard, w) for shard, w in each if len(w)]
            columns = [pa.array([s for s, _ in each], pa.int64()), pa.array([np.unique(w).view(np.int64) for _, w in each], pa.list_(pa.int64())), pa.array([len(w) for _, w in each], pa.int64()), pa.array([-(-len(w) // piece_words) for _, w in each], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "terms", "words", "pieces"])

    return items.select("shard", "t").mapInArrow(work, "shard bigint, terms array<bigint>, words bigint, pieces bigint")


def drop_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs in which no test item is found; same columns. Rows are told apart by id and text, so another text of the same id stays."""
    key = unused(docs, "_leak_key")
    name = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.hex(F.xxhash64(text_col)))
    found = find_leaks(docs.select(name.alias(key), F.col(text_col)), items, key, text_col, **how)
    bad = written(found.select(F.col(key).alias(f"{key}_bad")).distinct(), "leaks-bad")  # its size is known now: where it is small, no text is shuffled
    return docs.withColumn(key, name).join(bad, F.col(key) == F.col(f"{key}_bad"), "left_anti").drop(key)
