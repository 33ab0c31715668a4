"""Near copies: documents whose sets of distinct 5-word shingles have a Jaccard similarity of at least 0.8, and their components.

1. A pass over the texts makes, per document, its set's size and a digest of the set. Documents with one and the
   same set form a class, which one node stands for from here on.
2. A set that is similar to another shares at least four fifths of its shingles with it. A second pass counts, per class, how many of
   its shingles stand in other classes too; shingles with an upper half hash are left out for large sets, and the bound is lowered by
   as many. Classes under the bound have no similar set anywhere and are done; those left, the open ones, are written with their sets and a few
   least hashes.
3. Open classes that share a least hash meet in blocks. In a block each set looks for the leaders before it by T-occurrence search
   (DivideSkip over the inverted lists of the leaders), and links to those that are similar; else it becomes a leader. Large blocks
   are cut into chunks that share the block's first set; a second round lets one set of each component found so far meet across chunks.
4. Any link still missing joins two components. Sets with too few shingles that stand in more than one component are done; the others
   are cut into buckets by shingle hash. If two sets are similar, so are their parts in some bucket, and the parts share one of the
   first few shingles. So parts meet by those shingles; DivideSkip over each meeting finds the similar parts; pairs whose bitmaps differ
   in too many bits are no links, and the others are compared as wholes. Large meetings are cut into pairs of chunks.
Links of both kinds are exact: 100 * shared >= 80 * united. None that joins two components is lost (others are not sought), whatever
the sizes of groups. 64-bit hashes stand for shingles.

Lower case is of A-Z; words stand between characters 9 to 13 and 32. A text of fewer words than a shingle has its whole word
sequence as its one shingle; null, empty and blank texts have none and link with nothing. Ids are whole numbers. Rows with one id and
different texts are linked each for itself, and so are rows without an id; a component is named by its least id, or null if no row of
it has one. Ties, repeated rows and empty tables need no special care. Columns besides id and text are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import slices, unused, utf8, written
from tickloom.llm.components import components
from tickloom.llm.divide_skip import DivideSkip
from tickloom.llm.textvec import mix, shingle_sets

_U = np.uint64
LEAST_HASHES = 4
CHUNK = 1000
MEETING = 3000
#: Sets below this size are counted by all their shingles, larger ones by those with a lower half hash.
WHOLE = 128
_HALF = _U(1 << 63)
#: Rows that are made for one Arrow batch.
ROWS = 4096
#: Shingles that one task gathers when shared shingles are counted; there are as many tasks as that takes.
GATHERED = 2_000_000
BITMAP = 1024
_MARK_BITS = (1 << 48) - 2


def _needed(n: int) -> int:
    """Least overlap of a set of n with any set that is similar to it."""
    return -(-80 * n // 100)


def similar(shared: int, n: int, m: int) -> bool:
    return 100 * shared >= 80 * (n + m - shared)


def _counted(s: np.ndarray) -> int:
    """How many shingles of a set are counted. A similar set, up to a quarter larger, sends all of these if it has them."""
    return len(s) if 5 * len(s) < 4 * WHOLE else int(np.searchsorted(s, _HALF))


def _class_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _short(digest: bytes) -> int:
    """64 bits of a digest."""
    return int.from_bytes(digest[:8], "little", signed=True)


def _sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    def work(batches):
        for whole in batches:
            for batch in slices(whole, text_col):
                sets = shingle_sets(*utf8(batch.column(1)), shingle)
                digest = [_class_key(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(list(map(_counted, sets)), pa.int64()), pa.array(digest, pa.binary()), pa.array([None if d is None else _short(d) for d in digest], pa.int64())], names=["id", "text_key", "n", "counted", "digest", "cls"])

    return docs.select(id_col, text_col, F.xxhash64(text_col).alias("_key")).mapInArrow(work, "id bigint, text_key bigint, n bigint, counted bigint, digest binary, cls bigint")


def _packed(part: np.ndarray, parts: int, columns: list[np.ndarray]) -> list[pa.Array]:
    """Rows (part, the bytes of each column's values that go there), for the parts that get any."""
    order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    some = np.flatnonzero(cuts[1:] > cuts[:-1])
    dealt = [c[order] for c in columns]
    return [pa.array(some, pa.int32()), *(pa.array([d[cuts[p] : cuts[p + 1]].tobytes() for p in some.tolist()], pa.binary()) for d in dealt)]


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal values."""
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(sorted_values)), bool), sorted_values[1:] != sorted_values[:-1]]))
    return first, np.diff(np.concatenate([first, [len(sorted_values)]]))


def _shared_counts(docs: DataFrame, text_col: str, shingle: int, parts: int) -> DataFrame:
    """cls (64 bits of a class's digest) and c: at least how many of its counted shingles stand in other classes too, and hardly more.

    A task counts a shingle by itself once it has met it in two classes, and sends it on for those two only: so a shingle that a third of
    all texts hold makes two entries a task. Of the counts that several tasks make for one class, the largest is taken."""

    def scatter(batches):
        done: set[int] = set()
        known = np.zeros(0, np.uint64)
        for whole in batches:
            for batch in slices(whole, text_col, 8 << 20):
                sets, names = [], []
                for s in shingle_sets(*utf8(batch.column(0)), shingle):
                    name = _short(_class_key(s)) if len(s) else 0
                    if len(s) and name not in done:
                        done.add(name)
                        names.append(name)
                        sets.append(s if len(s) < WHOLE else s[: np.searchsorted(s, _HALF)])
                if not sets:
                    continue
                cls = np.array(names, np.int64).view(np.uint64)
                flat, own = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
                order = np.argsort(flat)
                flat, own = flat[order], own[order]
                first, size = _runs(flat)
                old = known[np.minimum(np.searchsorted(known, flat[first]), len(known) - 1)] == flat[first] if len(known) else np.zeros(len(first), bool)
                fresh, lone = (size > 1) & ~old, (size == 1) & ~old
                known = np.union1d(known, flat[first[fresh]])
                out = np.concatenate([first[lone], first[fresh], first[fresh] + 1])
                mark = np.repeat(np.array([0, 1], np.uint64), [lone.sum(), 2 * fresh.sum()])  # whether its class has counted it already
                short = flat[out] & _U(_MARK_BITS) | mark
                sent = _packed((mix(flat[out]) % _U(parts)).astype(np.int64), parts, [short.astype(np.uint32), (short >> _U(32)).astype(np.uint16), cls[own[out]]])
                yield pa.RecordBatch.from_arrays([*sent, pa.nulls(len(sent[0]), pa.binary())], names=["part", "low", "mid", "classes", "counts"])
                counts = np.bincount(own[np.repeat(~lone, size)], minlength=len(sets)).astype(np.int64)
                some = np.flatnonzero(counts)
                part, classes, counts = _packed((mix(cls[some]) % _U(parts)).astype(np.int64), parts, [cls[some], counts[some]])
                none = pa.nulls(len(part), pa.binary())
                yield pa.RecordBatch.from_arrays([part, none, none, classes, counts], names=["part", "low", "mid", "classes", "counts"])

    def gather(batches):
        tokens, classes = [], []
        for b in batches:
            for part, low, mid, cls, own in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if own is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([x], pa.binary()) for x in (cls, own, bytes(len(own))))], names=["home", "classes", "own", "c"])
                else:
                    tokens.append(np.frombuffer(low, np.uint32).astype(np.uint64) | np.frombuffer(mid, np.uint16).astype(np.uint64) << _U(32))
                    classes.append(np.frombuffer(cls, np.uint64))
        if not tokens:
            return
        token, cls = np.concatenate(tokens), np.concatenate(classes)
        del tokens, classes
        order = np.argsort(token >> _U(1))
        token, cls = token[order], cls[order]
        met = np.repeat(*(lambda size: (size > 1, size))(_runs(token >> _U(1))[1]))
        token, cls = token[met], cls[met]
        order = np.lexsort((token & _U(1), cls, token >> _U(1)))
        token, cls = token[order], cls[order]
        first, size = _runs(token >> _U(1))
        cross = np.repeat(cls[first] != cls[first + size - 1], size)
        again = np.zeros(len(token), bool)
        again[1:] = (token[1:] >> _U(1) == token[:-1] >> _U(1)) & (cls[1:] == cls[:-1])
        found, counts = np.unique(cls[cross & ~again & (token & _U(1) == 0)], return_counts=True)
        out = _packed((mix(found) % _U(parts)).astype(np.int64), parts, [found, np.zeros(len(found), np.int64), counts.astype(np.int64)])
        yield pa.RecordBatch.from_arrays(out, names=["home", "classes", "own", "c"])

    def add_up(batches):
        packed: list[list] = [[], [], []]
        for b in batches:
            for k, kind in enumerate((np.uint64, np.int64, np.int64)):
                packed[k] += [np.frombuffer(x, kind) for x in b.column(k + 1).to_pylist()]
        if packed[0]:
            cls, at = np.unique(np.concatenate(packed[0]), return_inverse=True)
            own, c = np.zeros(len(cls), np.int64), np.zeros(len(cls), np.int64)
            np.maximum.at(own, at, np.concatenate(packed[1]))
            np.add.at(c, at, np.concatenate(packed[2]))
            yield pa.RecordBatch.from_arrays([pa.array(cls.view(np.int64), pa.int64()), pa.array(own + c, pa.int64())], names=["cls", "c"])

    sent = docs.select(text_col).mapInArrow(scatter, "part int, low binary, mid binary, classes binary, counts binary")
    every = sent.repartition(parts, "part").mapInArrow(gather, "home int, classes binary, own binary, c binary")
    return every.repartition(parts, "home").mapInArrow(add_up, "cls bigint, c bigint")


def _sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """node, least, and tokens (the shingle set as bytes) of the wanted classes, each read from the one text of it that `wanted` names.

    The wanted classes may be a large share of all, so they are not broadcast, however few they happen to be."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.xxhash64(text_col).alias("_key"), F.col(text_col).alias("_text"))
    texts = texts.hint("merge").join(wanted, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_key") == F.col("text_key"))).select("node", "digest", "_text")

    def work(batches):
        for whole in batches:
            for batch in slices(whole, "_text"):
                sets = shingle_sets(*utf8(batch.column(2)), shingle)
                same = pa.array([_class_key(s) == d for s, d in zip(sets, batch.column(1).to_pylist(), strict=True)], pa.bool_())
                least = [[int(mix(s ^ _U(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)).min().astype(np.int64)) for k in range(LEAST_HASHES)] if len(s) else [] for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(least, pa.list_(pa.int64())), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "least", "tokens"]).filter(same)

    return texts.mapInArrow(work, "node bigint, least array<bigint>, tokens binary").dropDuplicates(["node"])


def _rows(batch: pa.RecordBatch, most: int = 64):
    """The rows of a batch as tuples; only so many at a time become Python values, since rows may be long."""
    for k in range(0, batch.num_rows, most):
        yield from zip(*(c.to_pylist() for c in batch.slice(k, most).columns), strict=True)


def _grouped(batches, keys: int):
    """Runs of equal values in the first `keys` columns of sorted batches, each as lists of the other columns."""
    key, rows = None, None
    for b in batches:
        for row in _rows(b):
            if row[:keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield key, rows


def _pairs_batch(pairs) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])


class _Sized:
    """DivideSkip indexes of sets by size, since two sets must share the more the larger both are."""

    def __init__(self):
        self.groups: dict[int, list] = {}

    def add(self, number: int, tokens: list) -> None:
        of = self.groups.setdefault(int(16 * math.log2(len(tokens))), [len(tokens), DivideSkip(), {}])
        of[0] = min(of[0], len(tokens))
        of[1].add(number, tokens)
        of[2][number] = len(tokens)

    def search(self, tokens: list) -> list[int]:
        """Numbers of the sets that are similar to this one."""
        n, out = len(tokens), []
        for least, index, sizes in self.groups.values():
            if 5 * n >= 4 * least:
                out += [k for k, shared in index.search(tokens, max(_needed(n), -(-4 * (n + least) // 9))) if similar(shared, n, sizes[k])]
        return out


def _leader_links(batches):
    """Links of each set of a block's chunk to the leaders before it. Rows come sorted; only the leaders of one chunk are held."""
    key, index, leaders = None, None, None
    for b in batches:
        links = []
        for pivot, chunk, _, node, data in _rows(b):
            if (pivot, chunk) != key:
                key, index, leaders = (pivot, chunk), _Sized(), []
            tokens = np.frombuffer(data, np.uint64).tolist()
            found = index.search(tokens)
            if found:
                links += [(node, leaders[k]) for k in found if leaders[k] != node]
            else:
                index.add(len(leaders), tokens)
                leaders.append(node)
        yield _pairs_batch(links)


def _block_links(sets: DataFrame, members: DataFrame) -> DataFrame:
    """Links found by leaders among the members (node, pivot) of each block."""
    chunks = members.groupBy("pivot").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")).where("chunks >= 1").select(F.col("pivot").alias("p2"), "chunks")
    placed = members.join(chunks, F.col("pivot") == F.col("p2"))
    spread = F.when(F.col("node") == F.col("pivot"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")))
    placed = placed.select(F.col("node").alias("n2"), "pivot", F.explode(spread).alias("chunk"))
    rows = sets.join(placed, F.col("node") == F.col("n2")).select("pivot", "chunk", (F.col("node") != F.col("pivot")).alias("later"), "node", "tokens")
    return rows.repartition("pivot", "chunk").sortWithinPartitions("pivot", "chunk", "later", "node").mapInArrow(_leader_links, "a bigint, b bigint")


def _blocks(sets: DataFrame) -> DataFrame:
    """node and pivot (the block's least node) for each node of a block of two or more."""
    each = sets.select("node", F.posexplode("least").alias("k", "h"))
    blocks = each.groupBy("k", "h").agg(F.min("node").alias("pivot"), F.count("*").alias("c")).where("c > 1").select(F.col("k").alias("k2"), F.col("h").alias("h2"), "pivot")
    return each.join(blocks, (F.col("k") == F.col("k2")) & (F.col("h") == F.col("h2"))).select("node", "pivot").distinct()


def _named(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """nodes with comp, the root of their component."""
    return nodes.join(roots.withColumnRenamed("node", "_r"), F.col("node") == F.col("_r"), "left").withColumn("comp", F.coalesce("root", "node")).drop("_r", "root")


def _bands(n: int) -> list[int]:
    """Bucket counts under which a set of n is dealt: powers of 4 that leave 16 to 63 shingles a bucket, its own and any that a similar set could have.

    Buckets of this size are seldom alike by a shared passage alone."""
    band = lambda m: 1 << 2 * max(0, ((max(m, 16) // 16).bit_length() - 1) // 2)
    return sorted({band(n), band(-(-4 * n // 5)), band(5 * n // 4)})


def _bitmap(tokens: np.ndarray) -> bytes:
    """A bit for each place, set if an odd number of shingles fall there: two sets differ in at least as many shingles as their bitmaps in bits."""
    return np.packbits(np.bincount((mix(tokens) % _U(BITMAP)).astype(np.int64), minlength=BITMAP) % 2 == 1).tobytes()


def _parts(batches):
    """Rows (key, node, comp, n, bits, part) of each set: every bucket's part under each of its rarest few shingles, but for those that stand in one component only.

    Of a shingle in a part, 32 bits travel: a clash adds a candidate, no more."""
    kinds = [pa.int64()] * 4 + [pa.binary()] * 2
    made: list[list] = [[] for _ in kinds]

    def batch():
        out = pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(made, kinds, strict=True)], names=["key", "node", "comp", "n", "bits", "part"])
        for x in made:
            x.clear()
        return out

    for b in batches:
        for k in range(b.num_rows):
            row = b.slice(k, 1)
            node, comp, data = (row.column(c)[0].as_py() for c in range(3))
            shared, df = (x.to_numpy(zero_copy_only=False) for x in row.column(3).flatten().flatten())
            tokens = np.frombuffer(data, np.uint64)
            often = np.zeros(len(tokens), np.int64)
            often[np.searchsorted(tokens, shared.view(np.uint64))] = df
            bits = _bitmap(tokens)
            for m in _bands(len(tokens)):
                bucket = (mix(tokens) % _U(m)).astype(np.int64)
                order = np.lexsort((tokens, often, bucket))
                cuts = np.searchsorted(bucket[order], np.arange(m + 1))
                dealt, rare = tokens[order], often[order]
                names = mix(dealt ^ _U(m)).astype(np.int64)
                for p in range(m):
                    lo, hi = int(cuts[p]), int(cuts[p + 1])
                    size = hi - lo
                    if size:
                        part = dealt[lo:hi].astype(np.uint32).tobytes()
                        for j in range(lo, lo + size - _needed(size) + 1):
                            if rare[j]:
                                for x, value in zip(made, (int(names[j]), node, comp, len(tokens), bits, part), strict=True):
                                    x.append(value)
                    if len(made[0]) >= ROWS:
                        yield batch()
    if made[0]:
        yield batch()


def _hopeful(rows: list[tuple]) -> list[np.ndarray]:
    """For each set (node, comp, n, bits, part), the sets before it that can be similar and are of another component, by sizes and bitmaps."""
    comp, n = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    bits = np.frombuffer(b"".join(r[3] for r in rows), np.uint64).reshape(len(rows), -1)
    out = []
    for k in range(len(rows)):
        may = (comp[:k] != comp[k]) & (100 * np.minimum(n[:k], n[k]) >= 80 * np.maximum(n[:k], n[k]))
        at = np.flatnonzero(may)
        # similar sets share at least 4 (n + m) / 9, so they differ in (n + m) / 9 at most
        out.append(at[9 * np.bitwise_count(bits[at] ^ bits[k]).sum(1, dtype=np.int64) <= n[at] + n[k]])
    return out


def _candidates(batches):
    """Pairs of sets of different components whose parts in a meeting are similar. A set that by sizes and bitmaps can have no similar set there is not searched for."""
    for _, rows in _grouped(batches, 3):
        if len({r[1] for r in rows}) < 2:
            continue
        index, pairs = _Sized(), []
        for k, before in enumerate(_hopeful(rows)):
            tokens = np.frombuffer(rows[k][4], np.uint32).tolist()
            if len(before):
                pairs += [(min(rows[k][0], rows[j][0]), max(rows[k][0], rows[j][0])) for j in set(before.tolist()).intersection(index.search(tokens))]
            index.add(k, tokens)
        yield _pairs_batch(sorted(pairs))


def _spread(batches):
    """A row for each shingle of each set."""
    for b in batches:
        for node, comp, data in _rows(b):
            tokens = np.frombuffer(data, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(tokens), node)), pa.array(np.full(len(tokens), comp)), pa.array(tokens)], names=["node", "comp", "t"])


def _remaining_links(sets: DataFrame, roots: DataFrame) -> DataFrame:
    """Links between sets (node, tokens) of different components."""
    named = written(_named(sets.select("node", "tokens"), roots), "jac-named")
    each = named.select("node", "comp", "tokens").mapInArrow(_spread, "node bigint, comp bigint, t bigint")
    cross = each.groupBy("t").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("df")).where("lo <> hi").select(F.col("t").alias("t2"), "df")
    met = each.join(cross, F.col("t") == F.col("t2")).groupBy("node").agg(F.collect_list(F.struct("t", "df")).alias("met")).select(F.col("node").alias("n2"), "met")
    still = named.join(met, F.col("node") == F.col("n2")).where("100 * size(met) >= 80 * (octet_length(tokens) / 8)").select("node", "comp", "tokens", "met")
    still = written(still, "jac-still")
    dealt = still.mapInArrow(_parts, "key bigint, node bigint, comp bigint, n bigint, bits binary, part binary")
    sizes = dealt.groupBy("key").agg(F.count("*").alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("c > 1 and lo <> hi")
    sizes = written(sizes.select(F.col("key").alias("key2"), F.ceil(F.col("c") / MEETING).cast("int").alias("cuts")), "jac-meetings")
    met = dealt.join(sizes, F.col("key") == F.col("key2")).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda o: F.struct(F.least("mine", o).alias("i"), F.greatest("mine", o).alias("j")))
    met = met.withColumn("cell", F.explode(cells)).select("key", "cell.i", "cell.j", "node", "comp", "n", "bits", "part")
    pairs = written(met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_candidates, "a bigint, b bigint").distinct(), "jac-pairs")
    left = pairs.join(still.select(F.col("node").alias("na"), F.col("tokens").alias("ta")), F.col("a") == F.col("na"))
    both = left.join(still.select(F.col("node").alias("nb"), F.col("tokens").alias("tb")), F.col("b") == F.col("nb")).select("a", "b", "ta", "tb")

    def check(batches):
        for b in batches:
            links = []
            for x, y, s, t in _rows(b):
                s, t = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
                if similar(len(np.intersect1d(s, t, assume_unique=True)), len(s), len(t)):
                    links.append((x, y))
            yield _pairs_batch(links)

    return both.mapInArrow(check, "a bigint, b bigint")


def _classes(sketches: DataFrame) -> DataFrame:
    """digest, n, counted, cls, the id and text key of the class's first row, and node: that id, or a name of the class's own where the id stands for another class or is null."""
    place = F.struct(F.col("id").isNull().alias("none"), "id", "text_key")
    grouped = sketches.where("digest is not null").groupBy("digest").agg(F.min(place).alias("p"), F.first("n").alias("n"), F.first("counted").alias("counted"), F.first("cls").alias("cls"))
    grouped = written(grouped.select("digest", "n", "counted", "cls", "p.id", "p.text_key"), "jac-grouped")
    first = grouped.where("id is not null").groupBy("id").agg(F.min("digest").alias("d2")).withColumnRenamed("id", "i2")
    own = F.when(F.col("digest") == F.col("d2"), F.col("id")).otherwise(F.xxhash64("digest").bitwiseOR(F.lit(-1 << 63)))
    return grouped.join(first, F.col("id") == F.col("i2"), "left").withColumn("node", own).drop("d2", "i2")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """id, n_shingles, class_id (least id with the same set), component_id, component_key (tells components apart where ids do not;
    null for a text without words) and text_key (a hash of the text) for every row."""
    sketches = written(_sketches(docs, id_col, text_col, shingle), "jac-sketch")
    classes = written(_classes(sketches), "jac-classes")
    named = _named(classes.select("digest", "id", "node"), _roots(docs, classes, id_col, text_col, shingle))
    named = named.withColumn("root_id", F.col("comp"))
    odd = written(named.where("comp = node and (id is null or id <> node)").select(F.col("comp").alias("c2")), "jac-odd")
    if not odd.isEmpty():  # components whose least node is not an id
        least = named.join(odd, F.col("comp") == F.col("c2")).groupBy("c2").agg(F.min("id").alias("least"))
        named = named.join(least, F.col("comp") == F.col("c2"), "left").withColumn("root_id", F.when(F.col("c2").isNull(), F.col("comp")).otherwise(F.col("least")))
    named = named.select(F.col("digest").alias("d2"), F.col("id").alias("class_id"), "root_id", "comp")
    out = sketches.select("id", "n", "digest", "text_key").join(named, F.col("digest") == F.col("d2"), "left")
    own = lambda c: F.when(F.col("d2").isNull(), F.col("id")).otherwise(F.col(c))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own("class_id").alias("class_id"), own("root_id").alias("component_id"), F.col("comp").alias("component_key"), "text_key")


def _roots(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """node and root for every class that is linked to a class with a lesser node."""
    spark = docs.sparkSession
    total = classes.agg(F.sum("counted")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // GATHERED))
    counts = _shared_counts(docs, text_col, shingle, parts)
    wanted = classes.join(counts.withColumnRenamed("cls", "cls2"), F.col("cls") == F.col("cls2"), "left").where("100 * (n - counted + coalesce(c, 0)) >= 80 * n")
    wanted = written(wanted.select("node", "digest", "id", "text_key"), "jac-open")
    sets = written(_sets_of(docs, wanted, id_col, text_col, shingle), "jac-sets")
    members = written(_blocks(sets), "jac-members")
    roots = written(components(written(_block_links(sets, members), "jac-links"), "jac-cc"), "jac-roots")
    # once more, with one set of each component in a block
    again = _named(members, roots).groupBy("pivot", "comp").agg(F.min("node").alias("node"))
    several = again.groupBy("pivot").agg(F.count("*").alias("c"), F.min("node").alias("least")).where("c > 1").select(F.col("pivot").alias("p2"), "least")
    again = written(again.join(several, F.col("pivot") == F.col("p2")).select("node", F.col("least").alias("pivot")).distinct(), "jac-again")
    roots = _widened(roots, written(_block_links(sets, again), "jac-more"), "jac-cc2")
    return _widened(roots, written(_remaining_links(sets, roots), "jac-last"), "jac-cc3")


def _widened(roots: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """The components after some more links."""
    if links.isEmpty():
        return roots
    return written(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links), name), f"{name}-roots")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """One row of docs for each component: the one with the least id, then the least hash of its text. Same columns.

    Rows with one id and different texts are each their own component's; rows without an id come after all others. Texts without words
    are in no component: of these, as of repeated rows, one stays for each id and text."""
    found = written(near_copies(docs, id_col, text_col, shingle).select(F.col(id_col).alias("_id"), F.col("text_key").alias("_tk"), "component_key"), "jac-found")
    place = F.struct(F.col("_id").isNull().alias("none"), "_id", "_tk")
    kept = found.where("component_key is not null").groupBy("component_key").agg(F.min(place).alias("p")).select("p._id", "p._tk")
    kept = kept.unionByName(found.where("component_key is null").select("_id", "_tk").distinct())
    twice = found.groupBy("_id", "_tk").agg((F.count("*") > 1).alias("_twice")).select(F.col("_id").alias("_id2"), F.col("_tk").alias("_tk2"), "_twice")
    kept = written(kept.join(twice, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_tk") == F.col("_tk2"))).select(*(F.col(c).alias(unused(docs, c)) for c in ("_id", "_tk", "_twice"))), "jac-kept")
    i, t, w = kept.columns
    key = unused(docs, "_key")
    rows = docs.withColumn(key, F.xxhash64(F.col(text_col))).join(kept, F.col(id_col).cast("bigint").eqNullSafe(F.col(i)) & (F.col(key) == F.col(t)))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    once = rows.where(~F.col(w)).select(*columns)
    if kept.where(F.col(w)).isEmpty():
        return once
    return once.unionByName(rows.where(F.col(w)).dropDuplicates([id_col, key]).select(*columns))
