"""The registered query of each text operator, with its production parameters, and SQL where it can express the query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import bpe, chat, decontaminate, jaccard, licenses, line_runs, mcd, path_tree, phrases, pii, pu_quality, ranked, secrets_forest
from tickloom.llm.common import table


def op1_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every text of documents: counts, a digest of the base spans, and all spans."""
    return pii.span_digests(pii.find_personal_data(table(spark, sf_dir, "documents")))


def op2_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle count and component of near copies of every text of documents."""
    return jaccard.near_copies(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_mcd_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and the robust verdict on every text of documents."""
    return mcd.quality_rules(table(spark, sf_dir, "documents")).drop("distance")


def op4_bm25_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents with every test item found in it."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every text of documents, learned from the positive labels that aren't held out."""
    return pu_quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count, and digests of the ids and of the decoded text, of every text of documents."""
    return bpe.encode_documents(table(spark, sf_dir, "documents"), result="digests")


def op7_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-blank lines of every text of documents, and which of its lines are later copies of a repeated run."""
    found = line_runs.repeated_lines(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("n_lines").cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), F.array_join(F.transform("removed", lambda p: p.cast("string")), ",").alias("removed"))


def op8_path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every url of pages."""
    return path_tree.url_verdicts(table(spark, sf_dir, "pages")).drop("labelled")


def op9_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of every text of documents, and the spans that the forest takes for secrets."""
    found = secrets_forest.scan_secrets(table(spark, sf_dir, "documents"))
    secret = F.filter("findings", lambda f: f["is_secret"])
    spans = F.array_join(F.transform(secret, lambda f: F.concat_ws(":", f["a"].cast("string"), f["b"].cast("string"))), ",")
    return found.select("doc_id", "n_candidates", F.size(secret).cast("long").alias("n_secrets"), spans.alias("spans"))


def op10_license_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence paragraphs of every text of documents, as family:start:end, and the number of unsure ones."""
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    known = F.filter("findings", lambda f: f["family"] != "unknown")
    spans = F.array_join(F.transform(known, lambda f: F.concat_ws(":", f["family"], f["a"].cast("string"), f["b"].cast("string"))), ",")
    return found.select("doc_id", F.size(known).cast("long").alias("n_licenses"), (F.size("findings") - F.size(known)).cast("long").alias("n_unknown"), spans.alias("spans"))


def op11_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from its windows; conversation -7 says what the template itself says."""
    words = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", words), (-7, 1, "assistant", words)], "conv_id bigint, turn bigint, role string, text string")
    return chat.conversation_digests(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of two or three words of each language of documents."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all documents for every item of benchmark."""
    return ranked.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sanitise": op1_sanitise,
    "op2_shingle_join": op2_shingle_join,
    "op3_mcd_rules": op3_mcd_rules,
    "op4_bm25_leaks": op4_bm25_leaks,
    "op5_pu_quality": op5_pu_quality,
    "op6_bpe": op6_bpe,
    "op7_line_runs": op7_line_runs,
    "op8_path_templates": op8_path_templates,
    "op9_secret_forest": op9_secret_forest,
    "op10_license_paragraphs": op10_license_paragraphs,
    "op11_chat_windows": op11_chat_windows,
    "op12_collocations": op12_collocations,
    "op13_ranked_search": op13_ranked_search,
}
ORACLES: dict[str, str] = {
    "op2_shingle_join": """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p, len(w) AS k FROM w),
t AS (SELECT DISTINCT doc_id, t FROM (SELECT doc_id, p, k, concat_ws(' ', x, lead(x, 1) OVER d, lead(x, 2) OVER d, lead(x, 3) OVER d, lead(x, 4) OVER d) AS t FROM x WINDOW d AS (PARTITION BY doc_id ORDER BY p)) WHERE p <= k - 4 UNION SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT w.doc_id, count(t.t) AS n FROM w LEFT JOIN t ON t.doc_id = w.doc_id GROUP BY w.doc_id),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.t = b.t AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id, doc_id AS r FROM n UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, CAST(min(reach.r) AS BIGINT) AS component_id FROM n JOIN reach ON reach.doc_id = n.doc_id GROUP BY n.doc_id, n.n
""",
    "op7_line_runs": """
WITH l AS (SELECT doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: {'s': x, 'pos': i - 1}), recursive := true) FROM documents),
k AS (SELECT doc_id, s, pos, length(s) AS len, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS seq FROM l WHERE regexp_matches(s, '[^\\x20\\x09-\\x0D]')),
c AS (SELECT *, sum(len) OVER (PARTITION BY doc_id ORDER BY seq) AS upto FROM k),
runs AS (SELECT a.doc_id, a.seq AS a, b.seq AS b FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.seq BETWEEN a.seq AND a.seq + 119 WHERE b.upto - a.upto + a.len >= 120 AND (b.upto - b.len - a.upto + a.len < 120 OR b.upto - a.upto < 120)),
named AS (SELECT r.doc_id, r.a, r.b, string_agg(c.s, chr(10) ORDER BY c.seq) AS name FROM runs r JOIN c ON c.doc_id = r.doc_id AND c.seq BETWEEN r.a AND r.b GROUP BY r.doc_id, r.a, r.b),
later AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY name ORDER BY doc_id, a) > 1),
gone AS (SELECT DISTINCT c.doc_id, c.pos FROM later JOIN c ON c.doc_id = later.doc_id AND c.seq BETWEEN later.a AND later.b),
per AS (SELECT doc_id, count(*) AS m, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(count(k.pos) AS BIGINT) AS n_lines, CAST(coalesce(any_value(per.m), 0) AS BIGINT) AS n_removed, coalesce(any_value(per.removed), '') AS removed FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id LEFT JOIN per ON per.doc_id = d.doc_id GROUP BY d.doc_id
""",
    "op12_collocations": """
WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
p AS (SELECT lang, piece, count(*) AS m FROM piece GROUP BY lang, piece),
w AS (SELECT lang, m, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
total AS (SELECT lang, sum(m * len(w)) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, phrase, sum(m) AS f FROM (SELECT lang, m, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 4) r(k) WHERE len(w) >= k) GROUP BY lang, k, phrase),
c AS (SELECT lang, k AS size, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k >= 2 AND f >= 10),
cut AS (SELECT c.*, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:size], ' ') AS y FROM c, range(1, 3) r(k) WHERE k < size),
s AS (SELECT cut.lang, cut.phrase, cut.size, cut.a, cut.k, gx.f AS l, gy.f AS r, (1000000::HUGEINT * cut.a * cut.a) // (gx.f::HUGEINT * gy.f) AS score FROM cut JOIN g gx ON gx.lang = cut.lang AND gx.phrase = cut.x JOIN g gy ON gy.lang = cut.lang AND gy.phrase = cut.y),
weakest AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, part, max(a) AS a FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part FROM c WHERE size = 3) GROUP BY lang, part),
kept AS (SELECT weakest.* FROM weakest LEFT JOIN longer ON longer.lang = weakest.lang AND longer.part = weakest.phrase WHERE longer.a IS NULL OR 100 * longer.a < 50 * weakest.a),
best AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT best.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM best JOIN total ON total.lang = best.lang WHERE rank <= 2000
""",
    "op13_ranked_search": """
WITH d AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM benchmark),
size AS (SELECT count(*) AS big_n, sum(len(w))::BIGINT AS big_l FROM d WHERE len(w) > 0),
tf AS (SELECT d, doc_id, n, t, count(*) AS tf FROM (SELECT d, doc_id, len(w) AS n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM i) GROUP BY d, doc_id, n, t),
weight AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, size GROUP BY t),
scored AS (SELECT i.item_id, tf.d, tf.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * big_n) // big_l))))) AS BIGINT) AS score FROM i JOIN tf ON tf.t = i.t JOIN weight ON weight.t = i.t, size GROUP BY i.item_id, tf.d, tf.doc_id),
best AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, d) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM best WHERE rank <= 10
""",
}
