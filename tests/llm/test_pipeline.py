"""The five stages, each against brute force on what it was given, on tables with nulls, empty and repeated rows, repeated ids and clashing names."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tickloom.llm import bpe, pu_quality
from tickloom.llm.common import Scratch, written

GAP = r"[^\x20\x09-\x0D]+"


def prose(rng, n):
    return " ".join("".join(rng.choices("etaoinshr", k=rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(40)
    where = str(tmp_path_factory.mktemp("corpus"))
    run = [prose(rng, 14) for _ in range(3)]
    item = {k: prose(rng, 30) + ". " + prose(rng, 9) + "." for k in range(3)}
    good = [". ".join(prose(rng, rng.randint(8, 30)) for _ in range(4)) + "." for _ in range(160)]
    texts = list(good)
    texts += [" ".join(w.upper() + "!!" for w in prose(rng, 60).split()) for _ in range(25)]
    texts += [g + "\n" + "\n".join(run) for g in good[:6]] + ["\n".join(run)]
    texts += [" ".join([*g.split()[:-1], "changed"]) for g in good[10:16]] + good[20:23]
    texts += [prose(rng, 40) + " " + item[k] + " " + prose(rng, 30) for k in range(3)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(0, prose(rng, 70)), (0, texts[0]), (None, prose(rng, 55)), (None, None), (900, None), (901, ""), (901, ""), (902, " \n ")]
    docs = spark.createDataFrame([(i, t, "en", None, None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "doc_id as _id", "1 as _key", "2 as _lr_d", "3 as item_id", "4 as comp", "5 as score", "6 as _leak_key")
    docs.write.parquet(f"{where}/documents.parquet")
    labels = [(i, int(i < 160), 0) for i in range(185)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([*item.items(), (9, None)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def sets_of(text):
    w = re.findall(GAP, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else (frozenset([tuple(w)]) if w else frozenset())


def test_each_stage_does_what_brute_force_does(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    before = rows_of(docs)

    kept = written(stages["quality"](spark, docs, folder), "t-quality")
    assert kept.columns == columns
    scored = {(r.doc_id, r.score) for r in pu_quality.score_documents(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    good = collections.Counter(i for i, s in scored if s >= 0.3)
    after = rows_of(kept)
    assert set(after) <= set(before) and {i for i, _ in after} == set(good)
    assert not {i for i, _ in after if i is not None and 160 <= i < 185} and len({i for i, _ in after} & set(range(160))) > 140

    cut = written(stages["lines"](spark, kept, folder), "t-lines")
    assert cut.columns == columns
    order = sorted({(i, t) for i, t in after}, key=lambda r: (r[0] is not None, r[0] or 0))
    seqs = [[(s, p) for p, s in enumerate((t or "").split("\n")) if re.search(GAP, s)] for _, t in order]
    first, gone = {}, collections.defaultdict(set)
    for k, q in enumerate(seqs):
        for a in range(len(q)):
            for b in range(a, len(q)):
                name = tuple(s for s, _ in q[a : b + 1])
                if sum(map(len, name)) >= 120 and first.setdefault(name, (order[k], a)) != (order[k], a) and order[k][0] != 0:
                    gone[order[k]].update(p for _, p in q[a : b + 1])
    want = []
    for row in after:
        lines = (row[1] or "").split("\n")
        if row[0] == 0:
            continue
        if not gone[row]:
            want.append(row)
        elif len(gone[row]) < sum(bool(re.search(GAP, s)) for s in lines):
            want.append((row[0], "\n".join(s for p, s in enumerate(lines) if p not in gone[row])))
    got = rows_of(cut)
    assert [r for r in got if r[0] != 0] == want and 191 not in {i for i, _ in got}
    assert all(r.n_chars == len(r.text) for r in cut.where("text is not null and doc_id < 900").collect())

    single = written(stages["copies"](spark, cut, folder), "t-copies")
    assert single.columns == columns
    classes = collections.defaultdict(list)
    for i, t in sorted(set(got), key=lambda r: (r[0] is None, r[0] or 0)):
        classes[sets_of(t) or (i, t)].append((i, t))
    keys = list(classes)
    root = list(range(len(keys)))
    for x in range(len(keys)):
        for y in range(x):
            if isinstance(keys[x], frozenset) and isinstance(keys[y], frozenset) and 100 * len(keys[x] & keys[y]) >= 80 * len(keys[x] | keys[y]):
                root = [root[y] if r == root[x] else r for r in root]
    groups = collections.defaultdict(list)
    for k, r in zip(keys, root, strict=True):
        groups[r] += classes[k]
    ones = rows_of(single)
    assert len(ones) == len(groups) == len(set(ones))
    for members in groups.values():
        (found,) = [o for o in ones if o in members]
        assert found[0] == min((i for i, _ in members if i is not None), default=None)

    free = written(stages["leaks"](spark, single, folder), "t-leaks")
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if r.text]
    assert free.columns == columns and rows_of(free) == [r for r in ones if not any(t in (r[1] or "") for t in items)]
    assert len(rows_of(free)) < len(ones)

    tok = bpe.tokenizer(None)
    ended = stages["encode"](spark, free, folder)
    want = sorted((i or -1, len(ids := tok.encode(t or "").ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows_of(free))
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in ended.collect()) == want
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, folder).collect()) == want


def test_empty_tables_go_through(spark, tmp_path):
    schema = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}
    for name, columns in schema.items():
        spark.createDataFrame([], columns).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_tables_go_with_their_own_scratch_only(spark):
    mine, other = Scratch(), Scratch()
    with mine:
        a = written(spark.range(3), "t-a")
    with other:
        b = written(spark.range(4), "t-b")
    other.release()
    assert a.count() == 3
    with pytest.raises(Exception, match="FILE_NOT_EXIST|PATH_NOT_FOUND|does not exist"):
        b.select(F.sum("id")).collect()


def test_weights_are_at_a_low_point_of_the_risk(spark):
    rng = random.Random(41)
    rows = [(i, prose(rng, rng.randint(30, 90)) if i % 3 else " ".join(w + "#|" for w in prose(rng, 50).split())) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stats = pu_quality.statistics(docs).withColumn("trusted", (F.col("id") % 3 > 0) & (F.col("id") < 200))
    model = pu_quality.fit(stats)
    got = stats.collect()
    x = np.array([r.stats for r in got])
    x = (np.concatenate([np.ones((len(x), 1)), x, np.sqrt(x), x * x], 1) - model["mean"]) / model["scale"]
    x[:, 0] = 1
    p = np.array([r.trusted for r in got])

    def risk(w):
        z = x @ w
        loss = lambda v: np.logaddexp(0, -v).mean()
        return model["prior"] * loss(z[p]) + max(0.0, loss(-z) - model["prior"] * loss(-z[p])) + 1e-3 / 2 * (w[1:] ** 2).sum()

    here = risk(model["w"])
    step = np.random.default_rng(2)
    assert here < risk(np.zeros(len(model["w"]))) and all(risk(model["w"] + 0.3 * step.normal(size=len(model["w"]))) > here - 1e-3 for _ in range(200))
    assert 0.45 < model["prior"] < 0.95  # two thirds are positive
