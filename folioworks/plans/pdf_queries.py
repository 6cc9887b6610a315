"""PDF documents: facts and annotations from orders, tag trees from their lines, in threes: one and the two below it."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioworks.operators import pdf
from folioworks.plans import surrogates
from folioworks.tables import table

TAGS = ("H1", "Kop", "H3", "H", "P", "Figure", "Bild", "Table", "Table", "TD", "TD", "TH", "TR")
ROLES = (("Kop", "Kop2"), ("Kop2", "H2"), ("Bild", "Figure"), ("P", "P"))
LABELS = ("click here", "", "Annual report", "www.example.org/a")


def facts(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pages = (1 + k % 4).cast("int")
    none = F.array().cast("array<int>")
    return table(spark, sf_dir, "orders").select(
        k.alias("doc_id"), (c % 3 != 1).alias("tagged"), F.when(k % 5 == 0, "").otherwise("en").alias("language"), F.when(c % 4 == 0, " ").otherwise("Report").alias("title"), (k % 3 != 0).alias("display_title"), pages.alias("pages"),
        F.when(c % 6 == 0, F.sequence(F.lit(1), pages)).when(c % 6 == 1, F.array(F.lit(1))).otherwise(none).alias("pages_without_text"), F.when(k % 2 == 0, F.array(F.lit(1))).otherwise(none).alias("pages_with_graphics"), (c % 4).cast("int").alias("fields"),
    )


def elements(spark, sf_dir):
    rows = surrogates.runs(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.count("*").cast("int").alias("lines"))
    first = (F.col("ord") - 1) % 3 == 0
    return rows.join(lines, "doc_id").select(
        "doc_id", F.col("ord").alias("pre"), F.when(first, F.least(F.col("ord") + 2, F.col("lines"))).otherwise(F.col("ord")).alias("last"), F.when(first, 0).otherwise(F.col("ord") - (F.col("ord") - 1) % 3).alias("parent"),
        F.get(F.array(*map(F.lit, TAGS)), (F.col("l_partkey") % len(TAGS)).cast("int")).alias("tag"), F.col("l_suppkey").alias("num"), F.when(F.col("l_suppkey") % 3 == 0, 1 + F.col("l_suppkey") % 5).alias("page"),
        F.when(F.col("l_suppkey") % 4 == 0, "A figure").alias("alt"), F.when(F.col("l_suppkey") % 7 == 0, "Words").alias("actual_text"),
    )


def pdf_findings(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    roles = keys.select("doc_id", F.inline(F.array(*[F.struct(F.lit(t).alias("tag"), F.lit(m).alias("mapped")) for t, m in ROLES])))
    k = F.col("doc_id")
    link = F.struct(F.lit(1).alias("page"), F.lit(1).alias("ord"), F.lit("Link").alias("subtype"), F.get(F.array(*map(F.lit, LABELS)), (k % 4).cast("int")).alias("contents"), F.lit("/x").alias("uri"))
    other = F.struct(F.lit(2).alias("page"), F.lit(1).alias("ord"), F.when(k % 5 == 0, "Screen").when(k % 5 == 1, "Movie").when(k % 5 == 2, "Link").otherwise("Text").alias("subtype"), F.lit("here").alias("contents"), F.lit(None).cast("string").alias("uri"))
    return pdf.detect(facts(spark, sf_dir), elements(spark, sf_dir), roles, keys.select("doc_id", F.inline(F.array(link, other))))


QUERIES = {"pdf_findings": pdf_findings}

# Tags with their roles as they come out, for the oracle.
ROLES_OUT = ("H1", "H2", "H3", "H", "P", "Figure", "Figure", "Table", "Table", "TD", "TD", "TH", "TR")
ORACLE_SQL = {
    "pdf_findings": f"""WITH f AS (SELECT o_orderkey AS doc_id, o_custkey % 3 <> 1 AS tagged, o_orderkey % 5 = 0 AS mute, o_custkey % 4 = 0 AS untitled, o_orderkey % 3 <> 0 AS shown, 1 + o_orderkey % 4 AS pages, o_custkey % 6 AS c6, o_orderkey % 2 = 0 AS drawn, o_custkey % 4 AS fields FROM orders),
r AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pre, {list(ROLES_OUT)}[(l_partkey % 13)::INT + 1] AS role, l_suppkey AS s FROM lineitem),
e AS (SELECT r.*, (pre - 1) // 3 AS third, CASE WHEN s % 3 = 0 THEN 1 + s % 5 END AS own, first_value(CASE WHEN s % 3 = 0 THEN 1 + s % 5 END) OVER (PARTITION BY doc_id, (pre - 1) // 3 ORDER BY pre) AS above FROM r JOIN f USING (doc_id) WHERE tagged),
a AS (SELECT *, coalesce('page ' || coalesce(own, above), 'the document') AS spot FROM e),
g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pre) AS n FROM a WHERE role = 'Figure'),
h0 AS (SELECT *, coalesce(last_value(CASE WHEN role <> 'H' THEN role[2]::INT END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pre), 1) AS level FROM a WHERE role[1] = 'H'),
h AS (SELECT *, lag(level) OVER (PARTITION BY doc_id ORDER BY pre) AS before FROM h0),
t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pre) AS n FROM a WHERE role = 'Table'),
tb AS (SELECT t.doc_id, t.pre, t.n, t.spot FROM t JOIN a ON a.doc_id = t.doc_id AND a.third = t.third AND a.pre > t.pre AND (t.pre - 1) % 3 = 0 GROUP BY ALL HAVING count(*) FILTER (a.role = 'TH') = 0 AND count(*) FILTER (a.role = 'TD') > 0),
u AS (SELECT doc_id, 1 AS rule, 0 AS place, CASE WHEN untitled THEN 'no-title' ELSE 'pdf-title-not-shown' END AS kind, 'document properties' AS location, CASE WHEN untitled THEN 'blocking' ELSE 'partial' END AS severity, NULL::VARCHAR AS anchor, CASE WHEN NOT untitled THEN 'Report' END AS detail FROM f WHERE untitled OR NOT shown
UNION ALL SELECT doc_id, 2, 0, 'no-language', 'document catalogue', 'blocking', NULL, NULL FROM f WHERE mute
UNION ALL SELECT doc_id, 3, 0, 'pdf-no-text', CASE WHEN c6 = 0 OR pages = 1 THEN 'all ' || pages || CASE WHEN pages = 1 THEN ' page' ELSE ' pages' END ELSE 'pages 1' END, 'blocking', NULL, NULL FROM f WHERE c6 < 2 AND drawn
UNION ALL SELECT doc_id, 4, 0, 'pdf-untagged', 'whole document', 'blocking', NULL, NULL FROM f WHERE NOT tagged
UNION ALL SELECT doc_id, 5, 0, 'image-alt', 'whole document', 'blocking', NULL, NULL FROM f WHERE NOT tagged AND drawn AND c6 >= 2
UNION ALL SELECT doc_id, 5, pre, 'image-alt', 'figure ' || n || ', ' || spot, 'partial', 'struct:' || s, NULL FROM g WHERE s % 4 <> 0 AND s % 7 <> 0
UNION ALL SELECT doc_id, 6, 0, 'no-headings', 'whole document', 'partial', NULL, count(*) FILTER (role = 'P')::VARCHAR FROM a GROUP BY doc_id HAVING count(*) FILTER (role = 'P') >= 6 AND count(*) FILTER (role[1] = 'H') = 0
UNION ALL SELECT doc_id, 7, pre, 'heading-skip', spot, 'partial', NULL, level || ' after ' || before FROM h WHERE level > before + 1
UNION ALL SELECT doc_id, 8, pre, 'table-header', 'table ' || n || ', ' || spot, 'partial', NULL, NULL FROM tb
UNION ALL SELECT doc_id, 9, 1, 'link-text', 'link 1, page 1', 'partial', NULL, CASE doc_id % 4 WHEN 0 THEN 'click here' WHEN 1 THEN '/x' ELSE 'www.example.org/a' END FROM f WHERE tagged AND doc_id % 4 <> 2
UNION ALL SELECT doc_id, 9, 2, 'link-text', 'link 2, page 2', 'partial', NULL, 'here' FROM f WHERE tagged AND doc_id % 5 = 2
UNION ALL SELECT doc_id, 10, 1, 'media', 'page 2', 'partial', NULL, NULL FROM f WHERE tagged AND doc_id % 5 < 2
UNION ALL SELECT doc_id, 11, 0, 'forms', fields || CASE WHEN fields = 1 THEN ' field' ELSE ' fields' END, 'partial', NULL, NULL FROM f WHERE tagged AND fields > 0)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY rule, place) AS seq, kind, location, severity, anchor, detail FROM u""",
}
