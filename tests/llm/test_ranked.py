"""Ranked search against scoring every document for every item, whatever the order, the shards and the clusters."""

import collections
import math
import random
import re

import numpy as np
import pytest

from tickloom.llm import bisection, ranked

DOCS = "doc_id long, text string, item_id string, score double"
ITEMS = "item_id long, text string, rank int"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text):
    return re.findall(TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, top=10):
    each = [(d[0], collections.Counter(terms(d[1]))) for d in docs]
    each = [(i, c, sum(c.values())) for i, c in each if c]
    n_docs, n_words = len(each), sum(n for _, _, n in each)
    df = collections.Counter(t for _, c, _ in each for t in c)
    wanted = collections.defaultdict(set)
    for i, text, *_ in items:
        wanted[i] |= set(terms(text))
    out = []
    for i, own in wanted.items():
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in own}
        scores = [(sum(w * (1000000000 * c[t] // (1000 * c[t] + 8 * (100 - 90 + 90 * n * n_docs // n_words))) for t, w in weight.items() if c[t]), name) for name, c, n in each]
        ranked_ = sorted((s for s in scores if s[0] > 0), key=lambda s: (-s[0], s[1] is None, s[1] or 0))[:top]
        out += [(i, rank, name, score) for rank, (score, name) in enumerate(ranked_, 1)]
    return sorted(out, key=str)


def corpus(seed=2, n=400):
    rng = random.Random(seed)
    topics = [["".join(rng.choices("aeioußé東x", k=rng.randint(1, 3))) for _ in range(40)] for _ in range(6)]
    docs = [(i * 7 % n, " ".join(rng.choices(rng.choice(topics), k=rng.choice([3, 12, 60]))) + rng.choice(["", "!", " A-B_c"]), "taken", 1.0) for i in range(n)]
    docs += [(1000 + i, None if i % 2 else " \n--- ", "x", 1.0) for i in range(4)] + [(2000 + i, docs[5][1], "x", 1.0) for i in range(40)] + [(3000, docs[6][1], "x", 1.0)] * 15 + [(None, docs[5][1], "x", 1.0)] * 2
    docs += [(-5, "word " * 30_000 + topics[0][0], "x", 1.0), (4000, "x" * 70_000 + " " + topics[1][0], "x", 1.0)]
    rng.shuffle(docs)
    items = [(i, " ".join(rng.choices(rng.choice(topics), k=rng.randint(1, 9))) + (" unheard" if i % 3 else ""), 1) for i in range(25)]
    items += [(25, None, 1), (26, "...", 1), (None, docs[3][1], 1), (27, "only unheard words here", 1), (28, docs[5][1], 1), (28, topics[2][0], 1), (28, topics[2][0], 1), (29, "word " * 5 + "A-b_C", 1)]
    return docs, items


@pytest.mark.parametrize("how", [{}, {"sample": 64, "shard_docs": 50, "cluster_docs": 4}, {"sample": 200, "cluster_docs": 16, "top": 3}, {"block_pairs": 40, "cluster_docs": 8}, {"sample": 1, "cluster_docs": 1, "probes": 1}])
def test_every_document_is_ranked(spark, how):
    docs, items = corpus()
    got = ranked.rank_documents(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), **how)
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=str) == brute(docs, items, how.get("top", 10))


def test_no_rows(spark):
    docs, items = corpus(n=10)
    some, none = spark.createDataFrame(docs, DOCS), spark.createDataFrame([], DOCS)
    assert ranked.rank_documents(none, spark.createDataFrame(items, ITEMS)).collect() == []
    assert ranked.rank_documents(some, spark.createDataFrame([], ITEMS)).collect() == []
    assert ranked.rank_documents(spark.createDataFrame([(1, "  ", "x", 1.0)], DOCS), spark.createDataFrame(items, ITEMS)).collect() == []


def test_clusters_are_left_out_by_their_bounds(spark, monkeypatch):
    """Documents of six topics: an item of one topic opens few clusters of the others."""
    rng = random.Random(1)
    docs = [(i, " ".join(f"t{i % 6}w{rng.randint(0, 30)}" for _ in range(40)), "x", 1.0) for i in range(600)]
    rows = bisection.Rows(np.concatenate([[0], np.cumsum([len(set(terms(d[1]))) for d in docs])]), np.concatenate([[int(t[1]) * 31 + int(t[3:]) for t in sorted(set(terms(d[1])))] for d in docs]))
    place = bisection.order(rows, 25)
    assert sorted(place.tolist()) == list(range(600))
    topics = [len({docs[d][0] % 6 for d in place[k : k + 25]}) for k in range(0, 600, 25)]
    assert sum(topics) / len(topics) < 2.5  # a random order has six in almost every cluster
    nodes = bisection.tree(rows, 200, 100)
    leaves = bisection.routed(rows, nodes, 200)
    assert len(set(leaves.tolist())) >= 6 and all((leaves[[d for d in range(600) if docs[d][1] == docs[k][1]]] == leaves[k]).all() for k in range(5))


def test_swaps_lower_the_cost():
    rng = np.random.default_rng(0)
    rows = bisection.Rows(np.arange(0, 402 * 5, 5), np.concatenate([rng.choice(20, 5, replace=False) + 20 * (k % 2) for k in range(401)]))

    def cost(right):
        a, b = bisection._degrees(rows, right, 40)
        return float((bisection._cost(a, int((~right).sum())) + bisection._cost(b, int(right.sum()))).sum())

    right = bisection.halves(rows, 40)
    assert abs(int(right.sum()) - int((~right).sum())) <= 1 and cost(right) < 0.8 * cost(np.arange(401) >= 200)
