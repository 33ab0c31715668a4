"""Personal data: base patterns, and information-theoretic sanitisation of the terms that give an entity away.

Base spans (email, ip, card, phone) are found by fixed patterns in every whole text. Each value is a protected entity, and so is its
kind. Over the whole corpus of n texts, n_e texts hold entity e, n_t texts hold term t, and n_et texts hold t within a few words of e:
    disclosure(e, t) = log2(n * n_et / (n_e * n_t))     (pointwise mutual information)
    information(e)   = log2(n / n_e).
A term that discloses at least information / alpha, and is seen in at least `support` different contexts, is a span of its own
wherever it stands in a text that holds the entity: generalised to its kind if it gives away the kind, removed if it gives away one
value. Copies of a text count in all four numbers alike, so they shift no disclosure, and they repeat a context, so they add nothing to
its support: words that are merely rare are left alone.

Terms are whole words of three letters or more, of any length. Null and empty texts have no spans. Repeated rows are treated each for
itself; a disclosure equal to the bar is over it. An empty table gives an empty result. Spans are in code points, end exclusive.
Columns besides id and text are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tickloom.llm.common import slices, written

KINDS = ("email", "ip", "card", "phone", "term")
_BEFORE_AT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_AFTER_AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?+[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, by start, then kind as listed."""
    out = []
    if "@" in text:
        at, done = text.find("@"), 0
        while at >= 0:
            start = at
            while start > done and text[start - 1] in _BEFORE_AT:
                start -= 1
            if start < at and (m := _AFTER_AT.match(text, at)):
                done = m.end()
                out.append((start, done, "email"))
            at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        if "." in text:
            for m in _IP.finditer(text):
                if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in m[0].split(".")):
                    out.append((*m.span(), "ip"))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and _luhn(d):
                out.append((*m.span(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                    out.append((*m.span(), "phone"))
    out.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return out


def joined(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def _value(span: str, kind: str) -> int:
    return _digest(f"{kind}:{span.lower()}")


def _terms(text: str, spans: list) -> list[tuple[str, int, int]]:
    """(term, start, end) of the terms of a text that no base span touches."""
    ends, starts, reach = [], [], 0
    for a, b, _ in spans:  # by start; ends as far as any span before reaches
        reach = max(reach, b)
        starts.append(a)
        ends.append(reach)
    out = []
    for m in _TERM.finditer(text):
        k = bisect_left(starts, m.end())
        if not k or ends[k - 1] <= m.start():
            out.append((m[0].lower(), *m.span()))
    return out


def _contexts(text: str, spans: list, terms: list, width: int) -> dict[tuple, set]:
    """The different contexts in which a text has a term within `width` terms on either side of an entity, by (kind, value or None, term)."""
    starts = [t[1] for t in terms]
    out: dict[tuple, set] = {}
    for a, b, kind in spans:
        lo, hi = bisect_left(starts, a), bisect_right(starts, b - 1)
        near = [t[0] for t in terms[max(0, lo - width) : lo] + terms[hi : hi + width]]
        context, value = _digest("\0".join(near)), _value(text[a:b], kind)
        for term in near:
            out.setdefault((kind, None, term), set()).add(context)
            out.setdefault((kind, value, term), set()).add(context)
    return out


_SCHEMA = "spans array<struct<a:int,b:int,kind:string>>, found array<struct<kind:string,value:bigint>>, terms array<struct<term:string,a:int,b:int>>, near array<struct<kind:string,value:bigint,term:string,contexts:array<bigint>>>, term string, n bigint"


def _scan(docs: DataFrame, id_col: str, text_col: str, width: int, most_terms: int) -> DataFrame:
    """One row per text (id, spans, entities found, and where there are any, terms and those near them), and rows of (term, texts with it), counted in each task and passed on at most_terms terms."""
    kind = docs.schema[id_col].dataType.simpleString()
    types = [f.dataType for f in T.StructType.fromDDL(_SCHEMA)]
    spans_type, found_type, terms_type, near_type = map(to_arrow_type, types[:4])
    names = ["id", "spans", "found", "terms", "near", "term", "n"]

    def work(batches):
        counts: dict[str, int] = {}
        id_type = None

        def flush():
            n = len(counts)
            out = pa.RecordBatch.from_arrays([pa.nulls(n, id_type), *(pa.nulls(n, t) for t in (spans_type, found_type, terms_type, near_type)), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=names)
            counts.clear()
            return out

        for whole in batches:
            id_type = whole.schema.field(0).type
            for batch in slices(whole, text_col):
                spans, found, terms, near = [], [], [], []
                for text in batch.column(1).to_pylist():
                    text = text or ""
                    base = base_spans(text)
                    spans.append([{"a": a, "b": b, "kind": k} for a, b, k in base])
                    at = _terms(text, base) if base else []
                    met = _contexts(text, base, at, width)
                    terms.append([{"term": t, "a": a, "b": b} for t, a, b in at])
                    found.append([{"kind": k, "value": None} for k in sorted({k for _, _, k in base})] + [{"kind": k, "value": v} for k, v in sorted({(k, _value(text[a:b], k)) for a, b, k in base})])
                    near.append([{"kind": k, "value": v, "term": t, "contexts": sorted(c)} for (k, v, t), c in met.items()])
                    for term in set(_TERM.findall(text.lower())):
                        counts[term] = counts.get(term, 0) + 1
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, spans_type), pa.array(found, found_type), pa.array(terms, terms_type), pa.array(near, near_type), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())], names=names)
                if len(counts) > most_terms:
                    yield flush()
        if counts:
            yield flush()

    return docs.select(id_col, text_col).mapInArrow(work, f"id {kind}, {_SCHEMA}")


def disclosing_terms(scanned: DataFrame, alpha: float = 1.2, support: int = 5) -> DataFrame:
    """kind, value, term and disclosure of the terms over the threshold. An entity is a kind (value null) or one value."""
    texts = scanned.where("spans is not null")
    n = texts.count()
    seen = texts.select(F.inline("near"))
    contexts = seen.select("kind", "value", "term", F.explode("contexts").alias("context")).distinct().groupBy("kind", "value", "term").agg(F.count("*").alias("c")).where(F.col("c") >= support)
    contexts = contexts.select(F.col("kind").alias("k3"), F.col("value").alias("v3"), F.col("term").alias("t3"))
    pairs = seen.groupBy("kind", "value", "term").agg(F.count("*").alias("n_et")).where(F.col("n_et") >= support)
    same = lambda k, v: (F.col("kind") == F.col(k)) & F.col("value").eqNullSafe(F.col(v))
    pairs = pairs.join(contexts, same("k3", "v3") & (F.col("term") == F.col("t3")), "left_semi")
    entities = texts.select(F.inline("found")).groupBy(F.col("kind").alias("k2"), F.col("value").alias("v2")).agg(F.count("*").alias("n_e"))
    terms = scanned.where("term is not null").groupBy("term").agg(F.sum("n").alias("n_t"))
    out = pairs.join(entities, same("k2", "v2")).join(terms, "term")
    disclosure, information = F.log2(n * F.col("n_et") / (F.col("n_e") * F.col("n_t"))), F.log2(n / F.col("n_e"))
    return out.withColumn("disclosure", disclosure).where((F.col("disclosure") > 0) & (F.col("disclosure") >= information / alpha)).select("kind", "value", "term", "disclosure")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, alpha: float = 1.2, support: int = 5, most_terms: int = 200_000) -> DataFrame:
    """id, base (array of spans), added (array of spans with kind term and an action: generalise or remove), for every row.

    width: terms on each side of a base span that count as its context; alpha: the larger, the lower the bar; support: different
    contexts that a term must be seen in; most_terms: distinct terms that a task holds before it passes their counts on."""
    scanned = written(_scan(docs, id_col, text_col, width, most_terms), "pii-scan")
    bad = written(disclosing_terms(scanned, alpha, support).select(F.col("term").alias("t2"), F.struct("kind", "value").alias("entity")), "pii-bad")
    texts = written(scanned.where("spans is not null").select("id", "spans", "found", "terms").withColumn("_row", F.monotonically_increasing_id()), "pii-texts")
    held = texts.select("_row", "found", F.inline("terms")).join(bad, F.col("term") == F.col("t2")).where(F.array_contains("found", F.col("entity")))
    added = held.groupBy("_row", "a", "b").agg(F.when(F.bool_and(F.col("entity.value").isNull()), "generalise").otherwise("remove").alias("action"))
    added = added.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("a", "b", F.lit("term").alias("kind"), "action"))).alias("added"))
    out = texts.drop("found", "terms").join(added, "_row", "left").drop("_row")
    return out.select(F.col("id").alias(id_col), F.col("spans").alias("base"), F.coalesce("added", F.expr("array()").cast("array<struct<a:int,b:int,kind:string,action:string>>")).alias("added"))


def sanitised(text: str | None, base: list, added: list) -> str:
    """The text with base spans and generalised terms replaced by their kind in brackets, and removed terms cut out. Overlapping spans fold into the first."""
    text, out, at = text or "", [], 0
    for s in sorted([*base, *added], key=lambda s: (s["a"], KINDS.index(s["kind"]))):
        if s["a"] < at:
            at = max(at, s["b"])
            continue
        out += [text[at : s["a"]], "" if s.get("action") == "remove" else f"[{s['kind'].upper()}]"]
        at = s["b"]
    return "".join([*out, text[at:]])


def span_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The columns of the registered query, from what find_personal_data returns."""
    text = lambda s: F.concat_ws(":", s["kind"], s["a"].cast("string"), s["b"].cast("string"))
    plain = F.transform("added", lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), s["kind"].alias("kind")))
    order = lambda s: F.struct(s["a"].alias("a"), F.array_position(F.lit(list(KINDS)), s["kind"]).alias("k"), s["b"].alias("b"), s["kind"].alias("kind"))
    both = F.sort_array(F.transform(F.concat("base", plain), order))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(id_col, *(count(k) for k in KINDS[:4]), F.sha2(F.array_join(F.transform("base", text), ","), 256).alias("base_sha256"), F.array_join(F.transform(both, text), ",").alias("spans"), F.size("added").cast("long").alias("n_added"))
