"""Headings in order and pages as painted."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioworks.operators import headings, painted
from folioworks.plans import surrogates
from folioworks.plans.colour_queries import RUNS_SQL


def levels(spark, sf_dir, least: int):
    r = surrogates.runs(spark, sf_dir)
    return r.select("doc_id", "ord", (F.lit(least) + F.col("l_partkey") % (7 - least)).cast("int").alias("level"))


def heading_skip(spark, sf_dir):
    return headings.skips(levels(spark, sf_dir, 1)).select("doc_id", "ord", "level", "previous")


def heading_repair(spark, sf_dir):
    return headings.pulled_up(levels(spark, sf_dir, 1)).select("doc_id", "ord", "level", F.col("corrected").cast("int").alias("corrected"))


def pdf_heading_h(spark, sf_dir):
    return headings.carried(levels(spark, sf_dir, 0)).select("doc_id", "ord", "level", "carried")


def sequence_inversion(spark, sf_dir):
    return painted.first_inversions(surrogates.blocks(spark, sf_dir))


def column_count(spark, sf_dir):
    return painted.count_columns(surrogates.blocks(spark, sf_dir))


def lined(spark, sf_dir):
    r = surrogates.runs(spark, sf_dir)
    top = F.col("l_quantity") % 4 * 10.0 + F.col("l_suppkey") % 3
    ink = F.when(F.col("l_partkey") % 4 == 0, F.lit(0xCC0000)).when(F.col("l_partkey") % 4 == 1, F.lit(0x000080)).otherwise(F.lit(0x101010))
    from folioworks.functions import colour

    return r.select("doc_id", "page", "ord", "text", F.lit(11.0).alias("points"), "bold", colour.from_number(ink).alias("fg"), top.alias("top"), (top + 9).alias("bottom"), (F.col("ord") * 10.0).alias("left"), (F.col("ord") * 10.0 + 9).alias("right"))


def line_groups(spark, sf_dir):
    return painted.line_numbers(lined(spark, sf_dir)).select("doc_id", "page", "ord", "line")


def colour_only(spark, sf_dir):
    return painted.colour_only_findings(lined(spark, sf_dir))


QUERIES = {f.__name__: f for f in (heading_skip, heading_repair, pdf_heading_h, sequence_inversion, column_count, line_groups, colour_only)}

BLOCKS_SQL = f"""{RUNS_SQL}, b AS (SELECT doc_id, page, ord, l_quantity*10.0 AS top, l_quantity*10.0 + 12 + l_suppkey % 3 AS bottom, l_partkey % 3*330.0 + l_suppkey % 5 AS l, l_partkey % 3*330.0 + l_suppkey % 5 + 250 + l_suppkey % 40 AS r FROM runs)"""
LINES_SQL = f"""{RUNS_SQL}, x AS (SELECT doc_id, page, ord, text, bold, CASE l_partkey % 4 WHEN 0 THEN 13369344 WHEN 1 THEN 128 ELSE 1052688 END AS ink, l_quantity % 4*10.0 + l_suppkey % 3 AS top, l_quantity % 4*10.0 + l_suppkey % 3 + 9 AS bottom, ord*10.0 AS l FROM runs),
y AS (SELECT *, lag(top) OVER w AS pt, lag(bottom) OVER w AS pb FROM x WINDOW w AS (PARTITION BY doc_id, page ORDER BY top, l, ord)),
z AS (SELECT *, sum(CASE WHEN pt IS NOT NULL AND (least(pb, bottom) - greatest(pt, top)) / least(pb - pt, bottom - top) > 0.5 THEN 0 ELSE 1 END) OVER w AS line, row_number() OVER w AS place FROM y WINDOW w AS (PARTITION BY doc_id, page ORDER BY top, l, ord))"""

ORACLE_SQL = {
    "heading_skip": f"WITH {RUNS_SQL}, h AS (SELECT doc_id, ord, (1 + l_partkey % 6)::INT AS level FROM runs), p AS (SELECT *, lag(level) OVER (PARTITION BY doc_id ORDER BY ord) AS previous FROM h) SELECT * FROM p WHERE level > previous + 1",
    "heading_repair": f"WITH RECURSIVE {RUNS_SQL}, h AS (SELECT doc_id, ord, (1 + l_partkey % 6)::INT AS level FROM runs), c AS (SELECT doc_id, ord, level, level AS corrected FROM h WHERE ord = 1 UNION ALL SELECT h.doc_id, h.ord, h.level, least(h.level, c.corrected + 1) FROM c JOIN h ON h.doc_id = c.doc_id AND h.ord = c.ord + 1) SELECT * FROM c",
    "pdf_heading_h": f"WITH {RUNS_SQL}, h AS (SELECT doc_id, ord, (l_partkey % 7)::INT AS level FROM runs) SELECT doc_id, ord, level, coalesce(last_value(CASE WHEN level > 0 THEN level END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord), 1) AS carried FROM h",
    "sequence_inversion": f"""WITH {BLOCKS_SQL}, g AS (SELECT doc_id, page, list_sort(list(abs(bottom - top)))[(count(*) // 2 + 1)::INT] / 2 AS gap FROM b GROUP BY 1, 2),
d AS (SELECT b.*, arg_max(ord, top*1000 - ord) OVER (PARTITION BY doc_id, page ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS deep, max(top) OVER (PARTITION BY doc_id, page ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS deepest FROM b),
f AS (SELECT d.* FROM d JOIN g USING (doc_id, page) WHERE bottom < deepest - gap)
SELECT doc_id, page, arg_min(deep, ord) AS earlier, min(ord) AS later FROM f GROUP BY 1, 2""",
    "column_count": f"""WITH {BLOCKS_SQL}, m AS (SELECT *, (l + r) / 2 AS centre, max(r) OVER (PARTITION BY doc_id, page ORDER BY l, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM b),
e AS (SELECT doc_id, page, reached AS edge FROM m WHERE l > reached AND (l - reached) / 1000 >= 0.04),
s AS (SELECT e.doc_id, e.page, edge FROM e JOIN m USING (doc_id, page) GROUP BY ALL HAVING count(*) FILTER (centre <= edge) >= 3 AND count(*) FILTER (centre > edge) >= 3),
c AS (SELECT doc_id, page, count(*) + 1 AS n FROM s GROUP BY 1, 2)
SELECT doc_id, page, coalesce(n, 1) AS columns FROM (SELECT DISTINCT doc_id, page FROM b) LEFT JOIN c USING (doc_id, page)""",
    "line_groups": f"WITH {LINES_SQL} SELECT doc_id, page, ord, line::BIGINT AS line FROM z",
    "colour_only": f"""WITH {LINES_SQL}, k AS (SELECT doc_id, page, line, ink, sum(length(text)) AS weight, min(place) AS first FROM z GROUP BY ALL),
d AS (SELECT doc_id, page, line, count(*) AS inks, arg_max(ink, weight*100000 - first) AS main FROM k GROUP BY 1, 2, 3),
a AS (SELECT z.doc_id, z.page, z.ink, z.place, z.ord FROM z JOIN d USING (doc_id, page, line) WHERE inks > 1 AND ink <> main AND NOT bold)
SELECT doc_id, page, upper(lpad(to_hex(ink), 6, '0')) AS fg, arg_min(ord, place) AS ord FROM a GROUP BY 1, 2, 3""",
}
