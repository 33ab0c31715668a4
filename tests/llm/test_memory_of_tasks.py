"""What a task holds besides its rows does not grow with them, and results stay those of the plain way."""

import gc
import random
import tracemalloc

import numpy as np
import pyarrow as pa

from tickloom.llm import decontaminate, jaccard, textvec
from tickloom.llm.common import utf8


def peak(work):
    """MB that work() took at most, and its result."""
    gc.collect()
    tracemalloc.start()
    try:
        out = work()
        return tracemalloc.get_traced_memory()[1] / 1e6, out
    finally:
        tracemalloc.stop()


def prose(rng, n):
    return " ".join("".join(rng.choices("etaoinshr", k=rng.randint(2, 6))) for _ in range(n))


def plain_hash(span: bytes) -> int:
    total = sum(int(textvec._LETTER[c]) * pow(textvec._MULT, k, 1 << 64) for k, c in enumerate(span)) + len(span) * 0xD6E8FEB86659FD93
    return int(textvec.mix(np.array([total % (1 << 64)], np.uint64))[0])


def test_hashes_are_those_of_single_spans():
    run = getattr(textvec, "_RUN", 1 << 15)
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 5 * run + 17, dtype=np.uint8)
    starts = np.array([0, 0, run - 3, run - 1, run, 2 * run - 1, 2 * run + 5, len(data) - 1, len(data), len(data), 7, run + 9])
    ends = np.array([0, 9, run + 3, run, run + 1, 4 * run, 5 * run + 2, len(data), len(data), len(data), 3 * run + 40, run + 9])
    assert textvec.span_hashes(data, starts, ends).tolist() == [plain_hash(data[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
    assert not len(textvec.span_hashes(data[:0], starts[:0], ends[:0]))


def test_hashing_words_takes_few_times_the_text():
    rng = random.Random(4)
    data, at = utf8(pa.array([prose(rng, 4000)] * 180 + [None, "", "x" * (1 << 20)]))
    took, _ = peak(lambda: textvec.shingle_sets(data, at))
    assert took < 11 * len(data) / 1e6  # 48 times before
    assert sum(p.nbytes for p in textvec._powers) <= 8 << 20


def test_the_bound_lays_out_few_postings_at_once():
    """Every word stands in many items, so that the hits' postings are far more than the words."""
    rng = random.Random(5)
    stock = [prose(rng, 1) + str(k) for k in range(300)]
    index = decontaminate.ItemIndex([(k, " ".join(rng.choices(stock, k=30))) for k in range(900)], 0.4)
    half = 32
    words = decontaminate._hashes(" ".join(rng.choice(stock) if rng.random() < 0.6 else prose(rng, 1) for _ in range(40_000)))
    words = np.concatenate([words, index.words[3], index.words[7]])
    first = np.array([0, 500, 500, 20_003, len(words)])
    row = np.repeat(np.arange(4), np.diff(first))
    inside = np.arange(len(words)) - first[row]
    base = np.concatenate([[0], np.cumsum(np.maximum(1, -(-np.diff(first) // half)))])
    took, got = peak(lambda: index.hopeful(words, base[row] + inside // half, inside >= half))
    want = []
    rare = {t: k for k, t in enumerate(index.rare.tolist())}
    for r in range(4):
        for w in range(base[r + 1] - base[r]):
            sums = index.common.copy()
            met = np.zeros(len(sums), bool)
            for t in words[first[r] + w * half : min(first[r + 1], first[r] + (w + 2) * half)].tolist():
                if t in rare:
                    own = slice(index.first[rare[t]], index.first[rare[t] + 1])
                    np.add.at(sums, index.post_item[own], index.post_weight[own])
                    met[index.post_item[own]] = True
            if (met & (sums >= index.threshold - 1e-9)).any():
                want.append(base[r] + w)
    assert got.tolist() == want and len(want) > 1
    assert took < 30  # 219 before


def parts_by_rows(rows):
    """The rows that jaccard._parts makes, set by set and shingle by shingle."""
    for node, comp, tokens, met in rows:
        for m in jaccard._bands(len(tokens)):
            buckets = {}
            for t in tokens:
                buckets.setdefault(int(textvec.mix(np.array([t], np.uint64))[0]) % m, []).append(t)
            for _, of in sorted(buckets.items()):
                of.sort(key=lambda t: (met.get(t, 0), t))
                part = np.array(of, np.uint64).astype(np.uint32).tobytes()
                for t in of[: len(of) - jaccard._needed(len(of)) + 1]:
                    if t in met:
                        yield int(textvec.mix(np.array([t ^ m], np.uint64)).astype(np.int64)[0]), node, comp, len(tokens), part


def test_parts_of_sets_are_made_in_bounded_batches():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64)) for n in (1, 3, 40, 700, 2000)] + [np.unique(rng.integers(0, 1 << 64, 900, dtype=np.uint64)) for _ in range(150)]
    met = [{t: int(rng.integers(2, 9)) for t in s.tolist() if rng.random() < 0.9} for s in sets]
    listed = pa.array([[{"t": int(np.uint64(t).astype(np.int64)), "df": d} for t, d in m.items()] for m in met], pa.list_(pa.struct([("t", pa.int64()), ("df", pa.int64())])))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sets))), pa.array([k % 7 for k in range(len(sets))]), pa.array([s.tobytes() for s in sets], pa.binary()), listed], names=["node", "comp", "tokens", "met"])
    some = lambda b: list(zip(*(b.column(k).to_pylist() for k in (0, 1, 2, 3, 5)), strict=True))
    got = [r for b in jaccard._parts(iter([batch.slice(0, 3), batch.slice(3, 4), batch.slice(0, 0)])) for r in some(b)]
    assert got == list(parts_by_rows([(k, k % 7, sets[k].tolist(), met[k]) for k in range(7)]))
    took, sizes = peak(lambda: [b.num_rows for b in jaccard._parts(iter([batch]))])
    assert max(sizes) < 2 * jaccard.ROWS and sum(sizes) > 8 * jaccard.ROWS
    assert took < 5
