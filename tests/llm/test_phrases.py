"""Collocations against a plain count, for both kinds of bucket: every phrase, whole texts, exact scores."""

import collections
import random
import re

import pytest

from tickloom.llm import phrases

SHAPE = "doc_id long, text string, lang string, phrase string, n long"


def brute(rows, longest=3, least=10, inside=50, top=2000):
    grams, words = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            for k in range(1, longest + 1):
                grams[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in grams.items():
        candidates = {p: a for p, a in f.items() if len(p) >= 2 and a >= least}
        longer = collections.Counter()
        for p, a in candidates.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i : i + m]] = max(longer[p[i : i + m]], a)
        found = []
        for p, a in candidates.items():
            if longer[p] and 100 * longer[p] >= inside * a:
                continue
            score, _, left, right = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, words[lang], -score))
    return sorted(out)


def texts(seed=5):
    rng = random.Random(seed)
    stock = ["".join(rng.choices("aeioußé東x", k=rng.randint(1, 3))) for _ in range(18)]
    rows = []
    for i in range(120):
        parts = [" ".join(rng.choices(stock, k=rng.randint(1, 9))) for _ in range(rng.randint(0, 12))]
        text = "".join(p + rng.choice([". ", ",", "\n", "!\t", ";  ", ":", "?", "\r\n", "\x0b", "\x0c", "  \t", " A "]) for p in parts)
        rows.append((i, text, rng.choice(["en", "en", "de", None]), "taken", 1))
    rows += [(200, None, "en", "x", 1), (201, "", None, "x", 1), (202, " \t\n ", "fr", "x", 1), (203, "once only here", "fr", "x", 1)] + [(300, "The SAME copied piece, and the same copied piece.", "en", "x", 1)] * 40
    rows += [(301, "tick tock " * 6000, "en", "x", 1), (302, "w" * 70_000 + " " + "w" * 70_000, "en", "x", 1)]
    return rows


@pytest.mark.parametrize("top,longest,inside", [(2000, 3, 50), (5, 3, 50), (2000, 4, 80), (2000, 2, 50)])
def test_collocations(spark, top, longest, inside):
    rows = texts()
    got = phrases.collocations(spark.createDataFrame(rows, SHAPE), top=top, longest=longest, inside=inside)
    assert sorted(map(tuple, got.collect())) == brute(rows, longest=longest, inside=inside, top=top)


def test_ties_and_no_rows(spark):
    rows = [(k, f"b{k % 3} c{k % 3}, ä{k % 3} c. z{k % 3} y", "en", "x", 1) for k in range(60)]
    got = phrases.collocations(spark.createDataFrame(rows, SHAPE)).collect()
    assert sorted(map(tuple, got)) == brute(rows) and len(got) == 9
    assert phrases.collocations(spark.createDataFrame([], SHAPE)).collect() == []


def test_small_runs_and_a_full_filter_give_the_same(spark):
    rows = texts(9)
    got = phrases.collocations(spark.createDataFrame(rows, SHAPE), run=2000, packed=5000, filter_bits=64)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_scores_pass_64_bits(spark):
    spark.sql("SELECT 1")
    a, other = 900_000_000_000_000, 900_000_000_000_007
    got = spark.sql(f"SELECT (cast(1000000 AS decimal(7,0)) * cast(cast({a} AS decimal(16,0)) * cast({a} AS decimal(16,0)) AS decimal(31,0))) div cast(cast({a} AS decimal(16,0)) * cast({other} AS decimal(16,0)) AS decimal(31,0)) AS s").first().s
    assert got == 1000000 * a * a // (a * other)
