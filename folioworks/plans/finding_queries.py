"""Findings, assessments, triage and prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioworks.operators import findings, triage
from folioworks.plans import catalog, surrogates
from folioworks.tables import table


def jobs_with_findings(spark, sf_dir):
    """Job, format of every job in lineitem."""
    ids = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id")).distinct()
    return ids.select("job_id", F.when(F.col("job_id") % 5 == 0, "web").when(F.col("job_id") % 2 == 0, "docx").otherwise("pdf").alias("format"))


def confirmed(spark, sf_dir):
    """Reviewer criteria that are confirmed: all four of every third job, one of others."""
    listed = F.explode(F.array(*map(F.lit, catalog.REVIEWER)))
    rows = jobs_with_findings(spark, sf_dir).select("job_id", listed.alias("criterion"))
    return rows.where((F.col("job_id") % 3 == 0) | (F.col("criterion") == "1.4.5"))


def assessed(spark, sf_dir):
    return findings.assess_all(jobs_with_findings(spark, sf_dir), surrogates.findings(spark, sf_dir), confirmed(spark, sf_dir))


def findings_surrogate(spark, sf_dir):
    rows = findings.with_criterion(surrogates.findings(spark, sf_dir))
    return rows.groupBy("kind", "criterion", findings.state_of().alias("state")).agg(F.count("*").alias("findings"))


def progress(spark, sf_dir):
    return findings.progress(surrogates.findings(spark, sf_dir)).select("job_id", "total", "open", "remediated", F.round("fraction", 6).alias("fraction"))


def group_by_kind(spark, sf_dir):
    return findings.group_by_kind(surrogates.findings(spark, sf_dir))


def assess_all(spark, sf_dir):
    return assessed(spark, sf_dir)


def summarise(spark, sf_dir):
    return findings.summarise(assessed(spark, sf_dir))


def conforms(spark, sf_dir):
    told = findings.headline(findings.summarise(assessed(spark, sf_dir)))
    return told.groupBy("headline").agg(F.count("*").alias("jobs"))


def acr_sections(spark, sf_dir):
    return findings.acr_sections(assessed(spark, sf_dir))


def job_status(spark, sf_dir):
    decided = surrogates.findings(spark, sf_dir).where("action is not null").select("job_id")
    touched = decided.union(confirmed(spark, sf_dir).select("job_id"))
    return findings.job_status(surrogates.jobs(spark, sf_dir), findings.summarise(assessed(spark, sf_dir)), touched)


def rebuild_membership(spark, sf_dir):
    """Detecting again finds the lines of even parts, and adds those of every seventh supplier at a new place."""
    before = surrogates.findings(spark, sf_dir).select("job_id", "kind", "location", "remediated")
    lines = table(spark, sf_dir, "lineitem")
    names = F.array(*[F.lit(k) for k, _ in catalog.KINDS])
    kind = F.get(names, (F.col("l_partkey") % len(catalog.KINDS)).cast("int"))
    place = F.concat(F.lit("page "), (F.col("l_suppkey") % 9 + F.when(F.col("l_suppkey") % 7 == 0, 100).otherwise(0)).cast("string"))
    after = lines.where((F.col("l_partkey") % 2 == 0) | (F.col("l_suppkey") % 7 == 0)).select(F.col("l_orderkey").alias("job_id"), kind.alias("kind"), place.alias("location"), F.lit(False).alias("remediated"))
    out = findings.rebuilt(before, after)
    return out.groupBy("job_id").agg(F.count_if((F.col("origin") == "before") & F.col("remediated")).alias("fixed"), F.count_if((F.col("origin") == "before") & ~F.col("remediated")).alias("left"), F.count_if(F.col("origin") == "new").alias("new"))


def fixable(spark, sf_dir):
    rows = surrogates.findings(spark, sf_dir).join(F.broadcast(catalog.kinds(spark)), "kind").join(jobs_with_findings(spark, sf_dir), "job_id")
    can = F.when(F.col("format") == "docx", F.col("fixable_docx")).when(F.col("format") == "pdf", F.col("fixable_pdf")).otherwise(False)
    return rows.groupBy("format", "review_input").agg(F.count_if(can & findings.is_open()).alias("fixable"), F.count_if(findings.is_open()).alias("open"), F.count_if(findings.is_dismissed()).alias("decided"))


def triaged(spark, sf_dir):
    return surrogates.facts(spark, sf_dir).withColumn("tier", triage.tier(F.col("pages"), F.col("textless"), F.col("tagged"), F.col("headings")))


def triage_tier(spark, sf_dir):
    return triaged(spark, sf_dir).select("job_id", "tier", "undescribed")


def tier_mix(spark, sf_dir):
    return triage.counts_by_tier(triaged(spark, sf_dir))


def figures_mix(spark, sf_dir):
    return triage.figures_mix(triaged(spark, sf_dir))


def quoted(spark, sf_dir):
    word = F.col("job_id") % 6 == 0
    work = triaged(spark, sf_dir).select("job_id", F.when(word, "docx").otherwise("pdf").alias("format"), F.when(~word, F.col("tier")).alias("tier"), F.col("undescribed").alias("figures"))
    return triage.quotes(work)


def quote_all(spark, sf_dir):
    return quoted(spark, sf_dir)


def best_offer(spark, sf_dir):
    return triage.best_offers(quoted(spark, sf_dir))


QUERIES = {f.__name__: f for f in (findings_surrogate, progress, group_by_kind, assess_all, summarise, conforms, acr_sections, job_status, rebuild_membership, fixable, triage_tier, tier_mix, figures_mix, quote_all, best_offer)}

KIND_LIST = "['" + "', '".join(k for k, _ in catalog.KINDS) + "']"
F_SQL = f"""f AS (SELECT l_orderkey AS job_id, {KIND_LIST}[(l_partkey % 20)::INT + 1] AS kind, CASE WHEN l_quantity < 5 THEN 'blocking' ELSE 'partial' END AS severity,
  l_linestatus = 'F' AS remediated, l_returnflag = 'A' AS dismissed, l_linestatus <> 'F' AND l_returnflag <> 'A' AS open, 'page ' || l_suppkey % 9 AS location FROM lineitem)"""
BASE = f"{catalog.CRITERIA_SQL}, {catalog.KINDS_SQL}, {F_SQL}"
A_SQL = f"""{BASE}, j AS (SELECT DISTINCT l_orderkey AS job_id, CASE WHEN l_orderkey % 5 = 0 THEN 'web' WHEN l_orderkey % 2 = 0 THEN 'docx' ELSE 'pdf' END AS format FROM lineitem),
k AS (SELECT job_id, criterion, count(*) FILTER (open) AS open, count(*) FILTER (open AND severity = 'blocking') AS blocking, count(*) FILTER (dismissed) AS dismissed FROM f JOIN kinds USING (kind) GROUP BY ALL),
a AS (SELECT j.job_id, j.format, c.ord, c.criterion, c.principle, coalesce(k.open, 0) AS open, coalesce(k.blocking, 0) AS blocking, coalesce(k.dismissed, 0) AS dismissed,
  CASE WHEN j.format <> 'web' AND c.exempt THEN 'Not Applicable' WHEN coalesce(k.blocking, 0) > 0 THEN 'Does Not Support' WHEN coalesce(k.open, 0) > 0 THEN 'Partially Supports'
    WHEN c.reviewer AND j.format <> 'web' AND NOT (j.job_id % 3 = 0 OR c.criterion = '1.4.5') THEN 'Needs Review' ELSE 'Supports' END AS status
  FROM j CROSS JOIN criteria c LEFT JOIN k ON k.job_id = j.job_id AND k.criterion = c.criterion),
s AS (SELECT job_id, bool_and(status IN ('Supports', 'Not Applicable')) AS conforms, count(*) FILTER (status <> 'Not Applicable') AS owed, count(*) FILTER (status IN ('Partially Supports', 'Does Not Support')) AS short,
  count(*) FILTER (status = 'Needs Review') AS review, sum(CASE WHEN status IN ('Partially Supports', 'Does Not Support') THEN blocking ELSE 0 END)::BIGINT AS blocking,
  sum(CASE WHEN status IN ('Partially Supports', 'Does Not Support') THEN open - blocking ELSE 0 END)::BIGINT AS other FROM a GROUP BY 1)"""
FACTS_SQL = """fa AS (SELECT o_orderkey AS job_id, (o_orderkey % 5)::INT AS pages, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 5 ELSE 0 END AS textless, o_orderkey % 3 <> 0 AS tagged, o_custkey % 4 AS headings, (o_custkey % 17)::INT AS undescribed, (o_custkey % 5)::INT AS raster FROM orders),
t AS (SELECT job_id, undescribed, raster, CASE WHEN pages > 0 AND textless = pages THEN 'scan' WHEN NOT tagged THEN 'untagged' WHEN headings > 0 THEN 'structured' ELSE 'tagged' END AS tier FROM fa)"""
Q_SQL = f"""{FACTS_SQL}, r AS (SELECT job_id, undescribed AS figures, CASE WHEN job_id % 6 = 0 OR tier = 'structured' THEN 'most' WHEN tier = 'untagged' THEN 'metadata' WHEN tier = 'tagged' THEN 'figures' ELSE 'nothing' END AS reach FROM t),
o(offer, rank) AS (VALUES ('assessment', 1), ('statement', 2), ('remediation', 3)),
q AS (SELECT job_id, offer, rank, reach, figures, NOT (offer <> 'assessment' AND (reach = 'nothing' OR (offer = 'remediation' AND reach = 'metadata'))) AS available FROM r CROSS JOIN o),
p AS (SELECT *, CASE WHEN available AND offer = 'remediation' THEN greatest(0, figures - 10) ELSE 0 END::BIGINT AS extra_figures,
  CASE WHEN NOT available THEN NULL WHEN offer = 'assessment' THEN 0 WHEN offer = 'statement' THEN 4900 ELSE CASE WHEN reach = 'most' THEN 14900 ELSE 9900 END + greatest(0, figures - 10)*300 END::BIGINT AS cents FROM q)"""

ORACLE_SQL = {
    "findings_surrogate": f"WITH {BASE} SELECT kind, criterion, CASE WHEN remediated THEN 'Fixed' WHEN dismissed THEN 'Dismissed' WHEN severity = 'blocking' THEN 'Blocking' ELSE 'Open' END AS state, count(*) AS findings FROM f JOIN kinds USING (kind) GROUP BY ALL",
    "progress": f"WITH {F_SQL} SELECT job_id, count(*) AS total, count(*) FILTER (open) AS open, count(*) FILTER (NOT open) AS remediated, round(count(*) FILTER (NOT open) / count(*), 6) AS fraction FROM f GROUP BY 1",
    "group_by_kind": f"WITH {BASE}, g AS (SELECT job_id, kind, kind_ord, count(*) AS findings, count(*) FILTER (open) AS open, bool_or(open AND severity = 'blocking') AS blocking FROM f JOIN kinds USING (kind) GROUP BY ALL) SELECT job_id, kind, findings, open, blocking, row_number() OVER (PARTITION BY job_id ORDER BY blocking DESC, open DESC, kind_ord)::INT AS place FROM g",
    "assess_all": f"WITH {A_SQL} SELECT job_id, format, ord, criterion, status, open, blocking, dismissed FROM a",
    "summarise": f"WITH {A_SQL} SELECT * FROM s",
    "conforms": f"WITH {A_SQL} SELECT CASE WHEN conforms THEN 'conforms' WHEN short = 0 THEN 'awaits review' ELSE 'falls short' END AS headline, count(*) AS jobs FROM s GROUP BY 1",
    "acr_sections": f"WITH {A_SQL} SELECT job_id, principle, count(*) FILTER (status = 'Supports') AS supports, count(*) FILTER (status IN ('Partially Supports', 'Does Not Support')) AS short, count(*) FILTER (status = 'Needs Review') AS review, coalesce(string_agg(CASE WHEN status IN ('Partially Supports', 'Does Not Support') THEN criterion END, ', ' ORDER BY ord), '') AS short_criteria FROM a GROUP BY 1, 2",
    "job_status": f"WITH {A_SQL} SELECT o_orderkey AS job_id, CASE WHEN conforms THEN 'delivered' WHEN s.job_id IS NOT NULL THEN 'in-review' WHEN o_orderstatus = 'P' THEN 'remediated' ELSE 'detected' END AS status FROM orders LEFT JOIN s ON s.job_id = o_orderkey",
    "rebuild_membership": f"""WITH {F_SQL}, n AS (SELECT l_orderkey AS job_id, {KIND_LIST}[(l_partkey % 20)::INT + 1] AS kind, 'page ' || (l_suppkey % 9 + CASE WHEN l_suppkey % 7 = 0 THEN 100 ELSE 0 END) AS location FROM lineitem WHERE l_partkey % 2 = 0 OR l_suppkey % 7 = 0),
b AS (SELECT f.job_id, f.remediated OR NOT EXISTS (SELECT 1 FROM n WHERE n.job_id = f.job_id AND n.kind = f.kind AND n.location = f.location) AS fixed, false AS new FROM f),
w AS (SELECT n.job_id, false AS fixed, true AS new FROM n WHERE NOT EXISTS (SELECT 1 FROM f WHERE n.job_id = f.job_id AND n.kind = f.kind AND n.location = f.location))
SELECT job_id, count(*) FILTER (fixed AND NOT new) AS fixed, count(*) FILTER (NOT fixed AND NOT new) AS left, count(*) FILTER (new) AS new FROM (SELECT * FROM b UNION ALL SELECT * FROM w) GROUP BY 1""",
    "fixable": f"""WITH {F_SQL}, x AS (SELECT *, CASE WHEN job_id % 5 = 0 THEN 'web' WHEN job_id % 2 = 0 THEN 'docx' ELSE 'pdf' END AS format, CASE kind WHEN 'image-alt' THEN 'alt' WHEN 'link-text' THEN 'text' ELSE 'judge' END AS review_input FROM f)
SELECT format, review_input, count(*) FILTER (open AND (format = 'docx' AND kind IN {catalog.FIXABLE['docx']} OR format = 'pdf' AND kind IN {catalog.FIXABLE['pdf']})) AS fixable, count(*) FILTER (open) AS open, count(*) FILTER (dismissed) AS decided FROM x GROUP BY 1, 2""",
    "triage_tier": f"WITH {FACTS_SQL} SELECT job_id, tier, undescribed FROM t",
    "tier_mix": f"WITH {FACTS_SQL} SELECT count(*) FILTER (tier = 'scan') AS scan, count(*) FILTER (tier = 'untagged') AS untagged, count(*) FILTER (tier = 'tagged') AS tagged, count(*) FILTER (tier = 'structured') AS structured, round(count(*) FILTER (tier IN ('tagged', 'structured'))*100.0 / count(*))::BIGINT AS certifiable_percent FROM t",
    "figures_mix": f"WITH {FACTS_SQL} SELECT count(*) FILTER (undescribed > 0) AS needing, count(*) FILTER (undescribed > 0 AND raster > 0) AS draftable, coalesce(sum(undescribed) FILTER (undescribed > 0), 0)::BIGINT AS figures FROM t",
    "quote_all": f"WITH {Q_SQL} SELECT job_id, offer, available, cents, extra_figures, available AND offer <> 'assessment' AND reach <> 'most' AS caveat FROM p",
    "best_offer": f"WITH {Q_SQL} SELECT job_id, arg_max(offer, rank) AS offer, arg_max(cents, rank) AS cents FROM p WHERE available GROUP BY 1",
}
