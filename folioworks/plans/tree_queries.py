"""Containment, and reading order of marked content, on trees and runs derived from the order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioworks.operators import containment, reading
from folioworks.plans import surrogates
from folioworks.scans import numbered
from folioworks.tables import stored, table


def elements(spark, sf_dir):
    """A tree for each supplier: line i holds the lines up to i plus the largest power of two that divides i, less one."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("tree"), "l_orderkey", "l_linenumber", (F.col("l_partkey") % 5).alias("name"))
    rows = numbered(lines, ["tree"], ["l_orderkey", "l_linenumber", "name"])
    i = F.col("rank") + 1
    return stored(rows.select("tree", i.alias("pre"), F.least(i + i.bitwiseAND(-i) - 1, F.col("total")).alias("last"), "name"), "elements")


def contained(spark, sf_dir):
    """By tree: pairs of a 0 and the 1s below it, the first of these, and the innermost 2 around each 3."""
    rows = elements(spark, sf_dir)
    of = lambda n: rows.where(F.col("name") == n)
    all_ = containment.pairs(of(0), of(1), ["tree"]).groupBy("tree").agg(F.count("*").alias("pairs"), F.sum(F.col("holder.pre") * F.col("held.pre")).alias("product"))
    first = containment.first_in(of(0), of(1), ["tree"]).groupBy("tree").agg(F.sum(F.col("pre") * F.col("held.pre")).alias("first"))
    inner = containment.innermost(of(3), of(2), ["tree"]).groupBy("tree").agg(F.sum(F.col("pre") * F.col("holder.pre")).alias("inner"))
    return all_.join(first, "tree", "full").join(inner, "tree", "full")


def painted_runs(spark, sf_dir):
    """Blocks as runs, on pages by line number; some outside any marked content, some inside two, some of a tag that isn't there."""
    b = surrogates.runs(spark, sf_dir).join(surrogates.blocks(spark, sf_dir).drop("text", "page"), ["doc_id", "ord"])
    k = F.col("l_suppkey")
    mcid = (k % 4).cast("int")
    open_ = F.when(k % 7 == 0, F.array().cast("array<int>")).when(k % 7 == 1, F.array(F.lit(None).cast("int"))).when(k % 7 == 2, F.array(F.lit(9), mcid, F.lit(None).cast("int"))).otherwise(F.array(mcid))
    return b.select("doc_id", (F.col("ord") % 2 + 1).cast("int").alias("page"), "width", "ord", F.when(k % 11 == 0, " ").when(k % 13 == 0, "-").otherwise(F.col("text")).alias("text"), open_.alias("open"), "top", "bottom", "left", "right")


def tag_tree(spark, sf_dir):
    """An element for each order line with two marks, the second on a page of its own; some elements take the page around them."""
    r = surrogates.runs(spark, sf_dir)
    k = F.col("l_partkey")
    page = F.when(k % 3 != 0, k % 2 + 1).cast("int")
    above = F.when(k % 5 != 0, (k + 1) % 2 + 1).cast("int")
    mark = lambda m, p: F.struct(m.cast("int").alias("mcid"), p.cast("int").alias("page"))
    return r.select("doc_id", F.col("ord").alias("pre"), page.alias("page"), above.alias("above"), F.array(mark(k % 4, F.lit(None)), mark((k + 1) % 4, F.when(k % 2 == 0, k % 2 + 1))).alias("marks"))


def placed(spark, sf_dir):
    return stored(reading.placed_blocks(reading.marked_refs(tag_tree(spark, sf_dir)), painted_runs(spark, sf_dir)), "placed")


def reading_blocks(spark, sf_dir):
    return placed(spark, sf_dir).select("doc_id", "page", "mcid", "ord", "text", "top", "bottom", "left", "right")


def reading_findings(spark, sf_dir):
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_custkey") % 6 != 0).alias("tagged"))
    return reading.sequence_findings(docs, placed(spark, sf_dir))


QUERIES = {f.__name__: f for f in (contained, reading_blocks, reading_findings)}

TREE_SQL = """n AS (SELECT l_suppkey AS tree, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey % 5) AS pre, count(*) OVER (PARTITION BY l_suppkey) AS total, l_partkey % 5 AS name FROM lineitem),
e AS (SELECT tree, pre, least(pre + (pre & -pre) - 1, total) AS last, name FROM n)"""
RUNS_SQL = """r AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ord, 'part ' || l_partkey AS t, l_partkey AS k, l_suppkey AS s, l_quantity*10.0 AS top, l_quantity*10.0 + 12 + l_suppkey % 3 AS bottom, l_partkey % 3*330.0 + l_suppkey % 5 AS l FROM lineitem),
p AS (SELECT doc_id, ord, ord % 2 + 1 AS page, s % 4 AS mcid, CASE WHEN s % 13 = 0 THEN '-' ELSE t END AS text, top, bottom, l, l + 250 + s % 40 AS r FROM r WHERE s % 7 > 1 AND s % 11 <> 0),
m AS (SELECT doc_id, ord, 0 AS i, k % 4 AS mcid, coalesce(CASE WHEN k % 3 <> 0 THEN k % 2 + 1 END, CASE WHEN k % 5 <> 0 THEN (k + 1) % 2 + 1 END) AS page FROM r
  UNION ALL SELECT doc_id, ord, 1, (k + 1) % 4, coalesce(CASE WHEN k % 2 = 0 THEN 1 END, CASE WHEN k % 3 <> 0 THEN k % 2 + 1 END, CASE WHEN k % 5 <> 0 THEN (k + 1) % 2 + 1 END) FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord, i) - 1 AS place FROM m WHERE page IS NOT NULL),
g AS (SELECT doc_id, page, mcid, string_agg(text, ' ' ORDER BY ord) AS text, min(top) AS top, max(bottom) AS bottom, min(l) AS l, max(r) AS r FROM p GROUP BY 1, 2, 3),
b AS (SELECT g.*, place AS ord FROM g JOIN (SELECT doc_id, page, mcid, max(place) AS place FROM o GROUP BY 1, 2, 3) USING (doc_id, page, mcid))"""
ORACLE_SQL = {
    "contained": f"""WITH {TREE_SQL}, p AS (SELECT a.tree, a.pre AS x, b.pre AS y FROM e a JOIN e b ON a.tree = b.tree AND b.pre > a.pre AND b.pre <= a.last WHERE a.name = 0 AND b.name = 1),
q AS (SELECT a.tree, max(a.pre) AS x, b.pre AS y FROM e a JOIN e b ON a.tree = b.tree AND b.pre > a.pre AND b.pre <= a.last WHERE a.name = 2 AND b.name = 3 GROUP BY 1, 3),
f AS (SELECT tree, sum(x*y)::BIGINT AS first FROM (SELECT tree, x, min(y) AS y FROM p GROUP BY 1, 2) GROUP BY 1), g AS (SELECT tree, sum(x*y)::BIGINT AS inner FROM q GROUP BY 1), h AS (SELECT tree, count(*) AS pairs, sum(x*y)::BIGINT AS product FROM p GROUP BY 1)
SELECT tree, pairs, product, first, "inner" FROM h FULL JOIN f USING (tree) FULL JOIN g USING (tree)""",
    "reading_blocks": f"WITH {RUNS_SQL} SELECT doc_id, page, mcid, ord, text, top, bottom, l AS left, r AS right FROM b",
    "reading_findings": f"""WITH {RUNS_SQL}, d AS (SELECT o_orderkey AS doc_id, o_custkey % 6 <> 0 AS tagged FROM orders),
v AS (SELECT * FROM b WHERE text <> '-' AND length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) > 1), w AS (SELECT v.*, count(*) OVER (PARTITION BY doc_id, page) AS n FROM v JOIN d USING (doc_id) WHERE tagged),
gap AS (SELECT doc_id, page, list_sort(list(abs(bottom - top)))[(count(*) // 2 + 1)::INT] / 2 AS gap FROM w GROUP BY 1, 2),
dp AS (SELECT w.*, arg_max(text, top*1000 - ord) OVER z AS deep, max(top) OVER z AS deepest FROM w WHERE n > 1 WINDOW z AS (PARTITION BY doc_id, page ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
bad AS (SELECT dp.doc_id, dp.page, arg_min(deep, ord) AS earlier, arg_min(text, ord) AS later FROM dp JOIN gap USING (doc_id, page) WHERE bottom < deepest - gap GROUP BY 1, 2),
cut AS (SELECT *, CASE WHEN length(earlier) > 40 THEN substr(earlier, 1, 39) || '…' ELSE earlier END AS e, CASE WHEN length(later) > 40 THEN substr(later, 1, 39) || '…' ELSE later END AS l FROM bad)
SELECT doc_id, NULL::INT AS page, CASE WHEN tagged THEN 'partial' ELSE 'blocking' END AS severity, CASE WHEN tagged THEN 'unmatched' ELSE 'untagged' END AS reason, NULL::BIGINT AS columns, NULL::VARCHAR AS earlier, NULL::VARCHAR AS later FROM d WHERE NOT tagged OR doc_id NOT IN (SELECT doc_id FROM v)
UNION ALL SELECT doc_id, page, 'partial', 'inverted', NULL, e, l FROM cut""",
}
