"""URL verdicts from a path-template tree per host. DataFrame functions only.

Segments that look like numbers, ids or dates become wildcards at once, so a host's pages shrink to its path shapes; everything
after that works on the table of shapes. From the root down, a segment under a template becomes a wildcard where the template has
many different ones and this one is rare. From the leaves up, sibling branches that are alike are merged: each branch that goes on is
described by how its pages share out over what follows; those with the same most common continuation are pooled, and a branch that
passes a chi-square test against its pool takes the pool's name. Labels play no part in that, so branches without labelled pages merge
with branches that have some, and share their verdict. Both walks visit only the depths at which paths of a host part: along a chain of
segments without a fork, however long, there is nothing to generalise or merge.

A template's purity is the share of blocked pages among its labelled ones, smoothed towards its host's, and that towards the share
over all labelled pages. A template with labelled pages and a purity of least_purity or more is rejected. Pages labelled by a rule
follow the rule; the others follow their template, and are allowed if that is not rejected.

Null urls and urls without :// have empty host and path, fit no rule, and form a template of their own host ''. Repeated urls
count as often as they occur; of tied continuations the first in order counts as the most common. Urls of any length and depth are
taken whole. An empty table gives an empty result. Columns besides id and url are not read, so their names cannot clash.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import written

#: The rules of the registered query, as action, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: A segment that varies from page to page: a number, a long hexadecimal id, anything with three digits in a row, or a very long one; an extension stays.
_VARIES = r"^(?:[0-9]+|[0-9A-Fa-f-]{12,}|[^.]*[0-9]{3}[^.]*|.{41,}?)(\.[A-Za-z][A-Za-z0-9]{0,4})?$"
#: Rows of one shape that meet its verdict in one place; a more common shape is split over as many places as that takes.
_TOGETHER = 1_000_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    cut = F.instr(url, "://")
    rest = F.when(cut > 0, F.substr(url, cut + 3))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    host = F.translate(host, string.ascii_uppercase, string.ascii_lowercase)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_col(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as its text and its action; null where none does."""
    text, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text, action = F.when(fits, rule_host + rule_path).otherwise(text), F.when(fits, act).otherwise(action)
    return text, action


def shape_col(path: Column) -> Column:
    """The path with varying segments as wildcards, as an array of segments; the first is what stands after the leading slash."""
    return F.transform(F.slice(F.split(path, "/"), 2, 1 << 30), lambda s: F.regexp_replace(s, _VARIES, "*$1"))


def _with_segment(shape: Column, d: int, value: Column) -> Column:
    return F.transform(shape, lambda s, i: F.when(i == d, value).otherwise(s))


def _at(shapes: DataFrame, d: int) -> DataFrame:
    """Shapes with the template's first d segments and the next one."""
    return shapes.withColumn("_pre", F.slice("template", 1, d)).withColumn("_seg", F.get("template", F.lit(d)))


def _renamed(shapes: DataFrame, names: DataFrame, d: int) -> DataFrame:
    """Shapes whose segment d, under its prefix, takes the name that `names` (_h, _p, _s, _name) has for it."""
    at = _at(shapes, d)
    at = at.join(names, (at.host == names._h) & (at._pre == names._p) & (at._seg == names._s), "left")
    return at.withColumn("template", F.when(F.col("_name").isNotNull(), _with_segment(F.col("template"), d, F.col("_name"))).otherwise(F.col("template"))).select(*_COLUMNS)


_COLUMNS = ("host", "shape", "template", "n", "blocked", "allowed")


def _forks(shapes: DataFrame, since: int) -> list[int]:
    """The depths from `since` on at which some template of a host goes on in two ways or more, from one row for each shape and depth.

    Prefixes go by hashes here: a chance match would only add a depth at which there is nothing to do."""
    steps = F.transform(F.sequence(F.lit(since), F.size("template") - 1), lambda i: F.struct(i.alias("d"), F.xxhash64(F.slice("template", 1, i)).alias("p"), F.get("template", i).alias("s")))
    each = shapes.where(F.size("template") > since).select("host", F.explode(steps).alias("e"))
    ways = each.groupBy("host", "e.d", "e.p").agg(F.min("e.s").alias("a"), F.max("e.s").alias("b")).where("a <> b")
    return sorted(r.d for r in ways.select("d").distinct().collect())  # at most as many as the longest path has segments


def _generalised(shapes: DataFrame, max_literals: int, min_share: float) -> tuple[DataFrame, list[int]]:
    """From the root down: rare segments among many become wildcards. Only depths with a fork are visited: on a chain there is nothing to generalise.

    Also the depths with forks in what comes out."""
    forks, k = _forks(shapes, 0), 0
    while k < len(forks):
        d = forks[k]
        each = _at(shapes, d).where("_seg is not null").groupBy("host", "_pre", "_seg").agg(F.sum("n").alias("_c"))
        under = each.groupBy("host", "_pre").agg(F.count("*").alias("_k"), F.sum("_c").alias("_t")).where(F.col("_k") > max_literals).select(F.col("host").alias("_h"), F.col("_pre").alias("_p"), "_t")
        under = written(under, f"path-under-{d}")
        if not under.isEmpty():
            rare = each.join(under, (F.col("host") == F.col("_h")) & (F.col("_pre") == F.col("_p"))).where((F.col("_c") < min_share * F.col("_t")) & (F.col("_seg") != ""))
            shapes = written(_renamed(shapes, rare.select("_h", "_p", F.col("_seg").alias("_s"), F.lit("*").alias("_name")), d), f"path-wild-{d}")
            forks = [*forks[: k + 1], *_forks(shapes, d + 1)]  # prefixes that became one go on in the ways of all
        k += 1
    return shapes, _forks(shapes, 0) if forks else []


def _merged(shapes: DataFrame, forks: list[int]) -> DataFrame:
    """From the leaves up: sibling branches with like continuations get one name, {a|...} after the first of them. Without a fork there are no siblings."""
    for d in reversed(forks):
        cells = _at(shapes, d).where(F.size("template") > d + 1).withColumn("_rest", F.slice("template", d + 2, 1 << 30)).groupBy("host", "_pre", "_seg", "_rest").agg(F.sum("n").alias("m"))
        cells = written(cells, f"path-cells-{d}")
        branches = cells.groupBy("host", "_pre", "_seg").agg(F.sum("m").alias("_n"), (F.count("*") - 1).alias("_df"), F.min_by("_rest", F.struct(-F.col("m"), "_rest")).alias("_main"))
        pools = branches.groupBy("host", "_pre", "_main").agg(F.count("*").alias("_b"), F.sum("_n").alias("_pn")).where("_b > 1")
        branches = written(branches.join(pools, ["host", "_pre", "_main"]), f"path-branches-{d}")
        if branches.isEmpty():
            continue
        cells = cells.join(branches, ["host", "_pre", "_seg"])
        shares = cells.groupBy("host", "_pre", "_main", "_rest").agg((F.sum("m") / F.first("_pn")).alias("_share"))
        expected = F.col("_n") * F.col("_share")
        tested = cells.join(shares, ["host", "_pre", "_main", "_rest"]).withColumn("_x", (F.col("m") - expected) * (F.col("m") - expected) / expected - expected)
        # cells that a branch lacks add their expectation, which is _n less what is listed
        tested = tested.groupBy("host", "_pre", "_seg", "_main").agg((F.sum("_x") + F.max("_n")).alias("_chi"), F.max("_df").alias("_df"))
        like = written(tested.where(F.col("_chi") <= F.col("_df") + 2.33 * F.sqrt(2.0 * F.col("_df") + 1)), f"path-like-{d}")
        firsts = like.groupBy("host", "_pre", "_main").agg(F.count("*").alias("_some"), F.min("_seg").alias("_first")).where("_some > 1")
        names = like.join(firsts, ["host", "_pre", "_main"]).select(F.col("host").alias("_h"), F.col("_pre").alias("_p"), F.col("_seg").alias("_s"), F.concat(F.lit("{"), F.col("_first"), F.lit("|...}")).alias("_name"))
        shapes = written(_renamed(shapes, names, d), f"path-merged-{d}")
    return shapes


def _purity(blocked: Column, allowed: Column, prior: Column, strength: float) -> Column:
    return (blocked + strength * prior) / (blocked + allowed + strength)


def url_verdicts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, max_literals: int = 32, min_share: float = 0.02, strength: float = 10.0, least_purity: float = 0.8) -> DataFrame:
    """id, host, path, rule, verdict (allow or block), template, its labelled pages and its purity (smoothed share of blocked ones among them)."""
    url = F.col(url_col)
    host, path = host_and_path(url)
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    rule, action = rule_col(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "_action": action, "shape": shape_col(F.col("path"))})
    shapes = rows.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count_if(F.col("_action") == "block").alias("blocked"), F.count_if(F.col("_action") == "allow").alias("allowed"))
    shapes = written(shapes.withColumn("template", F.col("shape")).select(*_COLUMNS), "path-shapes")
    places = max(1, -(-(shapes.agg(F.max("n")).first()[0] or 0) // _TOGETHER))
    shapes, forks = _generalised(shapes, max_literals, min_share)
    shapes = _merged(shapes, forks)
    totals = [F.sum(c).alias(c) for c in ("blocked", "allowed")]
    overall = shapes.agg(F.coalesce(F.try_divide(F.sum("blocked"), F.sum("blocked") + F.sum("allowed")), F.lit(0.0)).alias("q")).first()[0]
    templates = written(shapes.groupBy("host", "template").agg(*totals), "path-templates")
    hosts = templates.groupBy("host").agg(*totals).select("host", _purity(F.col("blocked"), F.col("allowed"), F.lit(overall), strength).alias("_prior"))
    templates = templates.join(hosts, "host").select(F.col("host").alias("_h"), F.col("template").alias("_t"), (F.col("blocked") + F.col("allowed")).alias("labelled"), _purity(F.col("blocked"), F.col("allowed"), F.col("_prior"), strength).alias("purity"))
    judged = shapes.join(templates, (shapes.host == templates._h) & (shapes.template == templates._t)).select(F.col("host").alias("_host"), F.col("shape").alias("_shape"), F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "labelled", "purity")
    judged = judged.withColumn("_place2", F.explode(F.sequence(F.lit(0), F.lit(places - 1))))
    rows = rows.withColumn("_place", F.pmod(F.xxhash64(id_col), F.lit(places)).cast("int"))
    out = rows.join(judged, (rows.host == judged._host) & (rows["shape"] == judged["_shape"]) & (F.col("_place") == F.col("_place2")), "left")
    verdict = F.coalesce("_action", F.when((F.col("labelled") > 0) & (F.col("purity") >= least_purity), "block").otherwise("allow"))
    return out.select(id_col, "host", "path", "rule", verdict.alias("verdict"), "template", "labelled", "purity")
