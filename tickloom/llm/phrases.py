"""Phrase collocation mining: identical pieces counted once, n-grams weighted by multiplicity, parts looked up by shuffled requests.

Texts in lower case (A-Z) are split at stops, commas, colons, semicolons, `!`, `?` and line ends into pieces, and these into words at
spaces and tabs. Each task sends its different pieces with their counts to hash buckets; a bucket adds them up, so a piece that many
texts share is cut into n-grams once, with its multiplicity. The n-grams of a run of pieces, each once with its weight, go to the
bucket of their own hash, whatever their first words, so no word, pair or piece is hot. Words and pairs are counted first; longer
n-grams are sent only if their parts may be frequent, which loses none. In both buckets duckdb adds up in a bounded
memory, and spills to the task's own scratch folder, as Spark's own operators do; that is gone when the task ends, and tasks pass on
nothing through it.

Phrases of at least `least` occurrences are candidates; each asks for the counts of its parts at every cut, by a join on the part.
The lowest score over the cuts counts, ties go to the first cut. Candidates that stand in a longer one with at least `inside` percent of
their own count are dropped. Scores are exact up to counts of 10^15 (decimals of 38 digits).

Null and empty texts have no pieces, and a null language is `und`. Repeated rows count each. Ranks tie on score by count, then by the
phrase's bytes. Long pieces and texts are taken whole. Other columns are not read; an empty table gives no phrases.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import slices, utf8, written
from tickloom.llm.textvec import _LOWER, mix, span_hashes

#: What ends a piece, and what stands between words.
STOPS, GAPS = ".,;:!?\n\x0b\x0c\r", " \t"
_STOP, _GAP = np.zeros(256, bool), np.zeros(256, bool)
_STOP[[ord(c) for c in STOPS]] = True
_GAP[[ord(c) for c in GAPS]] = True
#: Memory of one bucket's sums before duckdb spills, and bytes of text that are worked off at once.
BUCKET_MEMORY, RUN = "128MB", 2 << 20
PACKED, FILTER_BITS = 16 << 20, 1 << 26


class Pieces:
    """The words of texts laid end to end, pieces apart: bytes with one space between two words of a piece, word spans, and each piece's first word."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        data = _LOWER[data]
        word = ~(_STOP | _GAP)[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[at] = True
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1] | edge[1:-1]
        last[:-1] &= ~word[1:] | edge[1:-1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        breaks = np.cumsum(_STOP[data] | edge[:-1])
        opens = np.ones(len(starts), bool)
        opens[1:] = breaks[starts[1:]] != breaks[starts[:-1]]
        joints = starts[~opens] - 1
        word[joints] = True
        data[joints] = 0x20
        upto = np.cumsum(word)
        self.data = data[word]
        self.starts = upto[starts] - 1
        self.ends = self.starts + (ends - starts)
        self.first = np.flatnonzero(opens)
        self.text = np.searchsorted(at, starts[self.first], "right") - 1

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each piece."""
        if not len(self.first):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return self.starts[self.first], self.ends[np.concatenate([self.first[1:], [len(self.starts)]]) - 1]


def _taken(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans of the bytes as strings."""
    size = ends - starts
    offsets = np.concatenate([[0], np.cumsum(size)])
    kind = np.int32 if len(data) + offsets[-1] < 1 << 31 else np.int64
    at = np.repeat((starts - offsets[:-1]).astype(kind), size)
    at += np.arange(offsets[-1], dtype=kind)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[at]))


class _Packer:
    """Gathers texts with counts by hash bucket, and gives them out packed, all languages of a bucket together: a row per bucket for every `most` bytes."""

    def __init__(self, buckets: int, most: int):
        self.buckets, self.most, self.held, self.size = buckets, most, {}, 0
        self.squeeze = zstandard.ZstdCompressor(level=3)

    def add(self, lang: str, texts: pa.Array, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        data, at = utf8(texts)
        bucket = (span_hashes(data, at[:-1], at[1:]) % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        lines, at = utf8(pc.binary_join_element_wise(texts.take(pa.array(order)), pa.scalar("", texts.type), pa.scalar("\n", texts.type)))  # no text holds a line end
        bucket, counts = bucket[order], counts[order]
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            self.held.setdefault(int(bucket[a]), {}).setdefault(lang, []).append((counts[a:b], lines[at[a] : at[b]].tobytes()))
        self.size += len(lines) + 8 * len(counts)
        if self.size >= self.most:
            yield self.packs()

    def packs(self) -> pa.RecordBatch:
        rows = []
        for bucket, langs in self.held.items():
            raw = []
            for lang, parts in langs.items():
                counts = np.concatenate([c for c, _ in parts])
                large = np.flatnonzero(counts > 255)
                name, lines = lang.encode(), [t for _, t in parts]
                raw += [np.array([len(name), len(counts), len(large), sum(map(len, lines))], "<i8").tobytes(), name, counts.clip(0, 255).astype(np.uint8).tobytes(), large.astype("<i8").tobytes(), counts[large].astype("<i8").tobytes(), *lines]
            rows.append((bucket, self.squeeze.compress(b"".join(raw))))
        self.held, self.size = {}, 0
        columns = list(zip(*rows, strict=True)) or [(), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary()), strict=True)], names=["bucket", "payload"])


def _unpacked(payload: bytes) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
    """Language, texts and counts of each part of a pack."""
    raw, at = zstandard.ZstdDecompressor().decompress(payload), 0
    while at < len(raw):
        k, n, m, size = np.frombuffer(raw, "<i8", 4, at).tolist()
        at += 32
        lang = raw[at : at + k].decode()
        counts = np.frombuffer(raw, np.uint8, n, at + k).astype(np.int64)
        at += k + n
        counts[np.frombuffer(raw, "<i8", m, at)] = np.frombuffer(raw, "<i8", m, at + 8 * m)
        lines = np.frombuffer(raw, np.uint8, size, at + 16 * m)
        at += 16 * m + size
        offsets = np.concatenate([[0], np.flatnonzero(lines == 10) - np.arange(n)]).astype(np.int64)
        yield lang, pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(lines[lines != 10])), counts


_PACKS = "bucket int, payload binary"


def _summed(batches, least: int) -> Iterator[pa.RecordBatch]:
    """The texts of a task's packs, each once by lang with the sum of its counts, from `least` on; the empty text always."""
    import duckdb

    shape = pa.schema([("lang", pa.string()), ("text", pa.large_string()), ("n", pa.int64())])

    def unpacked():
        for b in batches:
            for lang, texts, counts in (part for payload in b.column(1) for part in _unpacked(payload.as_py())):
                langs = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(texts), np.int32)), pa.array([lang])).cast(pa.string())
                yield pa.RecordBatch.from_arrays([langs, texts, pa.array(counts)], schema=shape)

    with tempfile.TemporaryDirectory() as spill, duckdb.connect() as db:
        db.execute(f"SET threads = 1; SET memory_limit = '{BUCKET_MEMORY}'; SET temp_directory = '{spill}'; SET preserve_insertion_order = false")
        packs = pa.RecordBatchReader.from_batches(shape, unpacked())  # noqa: F841  duckdb reads it by its name
        yield from db.sql(f"SELECT lang, text, CAST(sum(n) AS BIGINT) AS n FROM packs GROUP BY lang, text HAVING sum(n) >= {int(least)} OR text = ''").to_arrow_reader(1 << 16)


def _piece_packs(docs: DataFrame, buckets: int, run: int, packed: int) -> DataFrame:
    """The different pieces of each run of texts with their counts."""

    def work(batches):
        packer = _Packer(buckets, packed)
        for whole in batches:
            for batch in slices(whole, "text", run):
                data, at = utf8(batch.column(0))
                pieces = Pieces(data, at)
                langs = batch.column(1).take(pa.array(pieces.text))
                found = pa.table({"lang": langs, "text": _taken(pieces.data, *pieces.spans())}).group_by(["lang", "text"]).aggregate([("text", "count")])
                for lang in found["lang"].unique().to_pylist():
                    own = found.filter(pc.equal(found["lang"], lang))
                    yield from packer.add(lang, own["text"].combine_chunks(), own["text_count"].to_numpy())
        yield packer.packs()

    return docs.mapInArrow(work, _PACKS)


def _different_pieces(packs: DataFrame, packed: int) -> DataFrame:
    """Each piece once, packed again, with how often it occurs in all texts."""

    def work(batches):
        packer = _Packer(1, packed // 4)
        for batch in _summed(batches, 1):
            for lang in batch.column(0).unique().to_pylist():
                own = batch.filter(pc.equal(batch.column(0), lang))
                yield from packer.add(lang, own.column(1), own.column(2).to_numpy())
        yield packer.packs()

    return packs.mapInArrow(work, _PACKS)


def _slots(lang: str, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int) -> np.ndarray:
    """The place of a phrase of a language in the filter of frequent phrases."""
    own = np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))
    return (mix(span_hashes(data, starts, ends) ^ own) % np.uint64(bits)).astype(np.int64)


def _gram_packs(pieces: DataFrame, buckets: int, sizes: list[int], frequent: np.ndarray | None, run: int, packed: int) -> DataFrame:
    """n-grams of the different pieces, weighted by how often these occur. With sizes 1 and more the empty text counts the words.

    frequent: a filter that holds at least all frequent phrases of one word less; only n-grams whose two such parts pass it are sent."""

    def grams(lang: str, texts: pa.Array, counts: np.ndarray):
        found = Pieces(*utf8(texts))
        words = np.diff(np.concatenate([found.first, [len(found.starts)]]))
        weight, owner = np.repeat(counts[found.text], words), np.repeat(np.arange(len(found.first)), words)
        if 1 in sizes:
            yield pa.array([""], pa.large_string()), np.array([weight.sum()])
        for k in sizes:
            at = np.flatnonzero(owner[k - 1 :] == owner[: max(0, len(owner) - k + 1)])
            if frequent is not None and len(at):
                inner = np.flatnonzero(owner[k - 2 :] == owner[: len(owner) - k + 2])
                passes = np.zeros(len(owner) + 1, bool)
                slot = _slots(lang, found.data, found.starts[inner], found.ends[inner + k - 2], 8 * len(frequent))
                passes[inner] = frequent[slot >> 3] >> (slot & 7) & 1
                at = at[passes[at] & passes[at + 1]]
            if len(at):
                t = pa.table({"text": _taken(found.data, found.starts[at], found.ends[at + k - 1]), "n": weight[at]}).group_by("text").aggregate([("n", "sum")])
                yield t["text"].combine_chunks(), t["n_sum"].to_numpy()

    def work(batches):
        packer = _Packer(buckets, packed)
        for b in batches:
            for lang, texts, counts in (part for payload in b.column(1) for part in _unpacked(payload.as_py())):
                for some in slices(pa.record_batch([texts, pa.array(counts)], names=["text", "n"]), "text", run):
                    for g, n in grams(lang, some.column(0), some.column(1).to_numpy()):
                        yield from packer.add(lang, g, n)
        yield packer.packs()

    return pieces.mapInArrow(work, _PACKS)


def _counted(packs: DataFrame, least: int, bits: int) -> DataFrame:
    def work(batches):
        for b in _summed(batches, least):
            data, at = utf8(b.column(1))
            slot = np.zeros(b.num_rows, np.int64)
            for lang in b.column(0).unique().to_pylist():
                own = np.flatnonzero(pc.equal(b.column(0), lang).to_numpy(zero_copy_only=False))
                slot[own] = _slots(lang, data, at[:-1][own], at[1:][own], bits)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.string()), b.column(2), pa.array(slot)], names=["lang", "phrase", "n", "slot"])

    return packs.repartition("bucket").mapInArrow(work, "lang string, phrase string, n bigint, slot bigint")


def _filter(counts: DataFrame, size: int, bits: int) -> np.ndarray:
    """The places of the frequent phrases of `size` words, as bits of a string that is as long however many phrases there are."""
    words = counts.where(F.size(F.split("phrase", " ")) == size).groupBy(F.expr("slot div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 AS int))")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words["w"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint8)


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 3, least: int = 10, run: int = RUN, packed: int = PACKED, filter_bits: int = FILTER_BITS) -> DataFrame:
    """lang, phrase and its count n, for phrases of up to `longest` words that occur `least` times; the empty phrase has the number of all words.

    A phrase is frequent only if all its parts are: from three words on, only n-grams are sent whose parts pass a filter of the frequent
    ones. The filter has a fixed size (filter_bits, a multiple of 64); what passes it by chance is counted and falls under `least`. run: bytes
    of text that are worked off at once; packed: bytes that a task gathers before it gives them out."""
    buckets = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.coalesce(text_col, F.lit("")).alias("text"), F.coalesce(lang_col, F.lit("und")).alias("lang"))
    pieces = written(_different_pieces(_piece_packs(docs, buckets, run, packed).repartition("bucket"), packed), "phrase-pieces")
    parts = [written(_counted(_gram_packs(pieces, buckets, [1, 2][:longest], None, run, packed), least, filter_bits), "phrase-counts")]
    for k in range(3, longest + 1):
        parts.append(written(_counted(_gram_packs(pieces, buckets, [k], _filter(parts[-1], k - 1, filter_bits), run, packed), least, filter_bits), "phrase-counts"))
    return reduce(DataFrame.unionByName, parts).drop("slot")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 3, least: int = 10, inside: int = 50, top: int = 2000, **how) -> DataFrame:
    """The `top` phrases of each language by score: lang, rank, phrase, a (its count), l and r (counts of the parts at its weakest cut), n (words of the language), score."""
    counts = phrase_counts(docs, text_col, lang_col, longest, least, **how).withColumn("size", F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " "))))
    candidates = counts.where("size >= 2").select("lang", "phrase", F.col("n").alias("a"), "size", F.split("phrase", " ").alias("w"))
    known = counts.where("size >= 1").select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    part = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    cuts = candidates.select("lang", "phrase", "a", "size", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    cuts = cuts.join(known.withColumnsRenamed({"part": "left", "f": "l"}), ["lang", "left"]).join(known.withColumnsRenamed({"part": "right", "f": "r"}), ["lang", "right"])
    big = lambda c: F.col(c).cast("decimal(16,0)")
    cuts = cuts.withColumns({"over": F.lit(1000000).cast("decimal(7,0)") * (big("a") * big("a")).cast("decimal(31,0)"), "under": (big("l") * big("r")).cast("decimal(31,0)")})
    scored = cuts.withColumn("score", F.expr("over div under")).groupBy("lang", "phrase").agg(F.any_value("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("weakest"))
    # every shorter run of words of a candidate, with the candidate's count
    runs = candidates.where("size >= 3").select("lang", "a", "size", "w", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m"))
    runs = runs.select("lang", "a", "m", "w", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("p"))
    longer = runs.select("lang", part(F.col("p"), F.col("m")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
    kept = kept.select("lang", "phrase", "a", "weakest.l", "weakest.r", "weakest.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    total = counts.where("size = 0").select("lang", "n")
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
