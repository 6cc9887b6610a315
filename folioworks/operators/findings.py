"""Findings folded to assessments, summaries and reports.

`findings`: job_id, seq, kind, severity, remediated, action (of the decision, null if none), location. Lookups against the
catalogues are joins with tables of a fixed number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks.plans import catalog

NOT_APPLICABLE, FAILS, PARTLY, REVIEW, SUPPORTS = "Not Applicable", "Does Not Support", "Partially Supports", "Needs Review", "Supports"


def is_dismissed() -> Column:
    return F.coalesce(F.col("action") == "dismiss", F.lit(False))


def is_open() -> Column:
    """Neither fixed nor dismissed."""
    return ~F.col("remediated") & ~is_dismissed()


def state_of() -> Column:
    return F.when(F.col("remediated"), "Fixed").when(is_dismissed(), "Dismissed").when(F.col("severity") == "blocking", "Blocking").otherwise("Open")


def with_criterion(findings: DataFrame) -> DataFrame:
    return findings.join(F.broadcast(catalog.kinds(findings.sparkSession).select("kind", "kind_ord", "criterion")), "kind")


def progress(findings: DataFrame) -> DataFrame:
    """By job: total, open, remediated (what is no longer open) and its share, 1 without findings."""
    out = findings.groupBy("job_id").agg(F.count("*").alias("total"), F.count_if(is_open()).alias("open"))
    done = F.col("total") - F.col("open")
    return out.select("job_id", "total", "open", done.alias("remediated"), F.when(F.col("total") == 0, 1.0).otherwise(done / F.col("total")).alias("fraction"))


def group_by_kind(findings: DataFrame) -> DataFrame:
    """By job and kind, with the place in the order of reading: blocking first, then most open, then catalogue."""
    from pyspark.sql.window import Window

    groups = with_criterion(findings).groupBy("job_id", "kind", "kind_ord").agg(
        F.count("*").alias("findings"), F.count_if(is_open()).alias("open"), F.bool_or(is_open() & (F.col("severity") == "blocking")).alias("blocking")
    )
    order = Window.partitionBy("job_id").orderBy(F.desc("blocking"), F.desc("open"), "kind_ord")
    return groups.select("job_id", "kind", "findings", "open", "blocking", F.row_number().over(order).alias("place"))


def assess_all(jobs: DataFrame, findings: DataFrame, confirmed: DataFrame | None = None) -> DataFrame:
    """Job, criterion, status for each criterion of the catalogue.

    `jobs`: job_id, format (docx, pdf or web). `confirmed`: job_id, criterion that a reviewer has confirmed. Findings are
    counted by job and criterion first; each job then meets the 38 criteria, the counts and what was confirmed.
    """
    spark = jobs.sparkSession
    counts = with_criterion(findings).groupBy("job_id", "criterion").agg(
        F.count_if(is_open()).alias("open"), F.count_if(is_open() & (F.col("severity") == "blocking")).alias("blocking"), F.count_if(is_dismissed()).alias("dismissed")
    )
    listed = F.array(*[F.struct(F.lit(i + 1).alias("ord"), F.lit(c).alias("criterion")) for i, (c, _, _) in enumerate(catalog.CRITERIA)])
    owed = jobs.select("job_id", "format", F.explode(listed).alias("c")).select("job_id", "format", "c.ord", "c.criterion")
    out = owed.join(counts, ["job_id", "criterion"], "left")
    if confirmed is not None:
        out = out.join(confirmed.select("job_id", "criterion", F.lit(True).alias("confirmed")).distinct(), ["job_id", "criterion"], "left")
    else:
        out = out.withColumn("confirmed", F.lit(False))
    out = out.join(F.broadcast(catalog.coverage(spark)), ["format", "criterion"], "left")
    exempt = (F.col("format") != "web") & F.col("criterion").isin(*catalog.EXEMPT)
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    status = (
        F.when(exempt, NOT_APPLICABLE)
        .when(n("blocking") > 0, FAILS)
        .when(n("open") > 0, PARTLY)
        .when((F.col("coverage") == "reviewer") & ~F.coalesce("confirmed", F.lit(False)), REVIEW)
        .otherwise(SUPPORTS)
    )
    return out.select("job_id", "format", "ord", "criterion", status.alias("status"), n("open").alias("open"), n("blocking").alias("blocking"), n("dismissed").alias("dismissed"))


def summarise(assessed: DataFrame) -> DataFrame:
    """By job: conforms, criteria owed, short and in review, open findings that block and others, on owed criteria only."""
    status = F.col("status")
    short = status.isin(PARTLY, FAILS)
    blocking = F.sum(F.when(short, F.col("blocking")).otherwise(0))
    return assessed.groupBy("job_id").agg(
        F.bool_and(status.isin(SUPPORTS, NOT_APPLICABLE)).alias("conforms"),
        F.count_if(status != NOT_APPLICABLE).alias("owed"),
        F.count_if(short).alias("short"),
        F.count_if(status == REVIEW).alias("review"),
        blocking.alias("blocking"),
        (F.sum(F.when(short, F.col("open")).otherwise(0)) - blocking).alias("other"),
    )


def headline(summary: DataFrame) -> DataFrame:
    """One of three states of a job."""
    told = F.when(F.col("conforms"), "conforms").when(F.col("short") == 0, "awaits review").otherwise("falls short")
    return summary.select("job_id", told.alias("headline"))


def acr_sections(assessed: DataFrame) -> DataFrame:
    """By job and principle: counts of statuses and the criteria that fall short, in order."""
    principle = F.create_map(*[F.lit(x) for kv in catalog.PRINCIPLES.items() for x in kv])[F.substring("criterion", 1, 1)]
    short = F.filter(F.sort_array(F.collect_list(F.when(F.col("status").isin(PARTLY, FAILS), F.struct("ord", "criterion")))), lambda s: s.isNotNull())
    return assessed.withColumn("principle", principle).groupBy("job_id", "principle").agg(
        F.count_if(F.col("status") == SUPPORTS).alias("supports"),
        F.count_if(F.col("status").isin(PARTLY, FAILS)).alias("short"),
        F.count_if(F.col("status") == REVIEW).alias("review"),
        F.array_join(F.transform(short, lambda s: s["criterion"]), ", ").alias("short_criteria"),
    )


def job_status(jobs: DataFrame, summary: DataFrame, touched: DataFrame) -> DataFrame:
    """delivered if all conforms, in-review once a person has decided or confirmed anything, then remediated, else detected.

    `jobs` has remediated_at; `touched` the job_id of decisions and confirmations.
    """
    hands = touched.select("job_id").distinct().withColumn("hands", F.lit(True))
    joined = jobs.join(summary.select("job_id", "conforms"), "job_id", "left").join(hands, "job_id", "left")
    status = F.when(F.col("conforms"), "delivered").when(F.col("hands"), "in-review").when(F.col("remediated_at").isNotNull(), "remediated").otherwise("detected")
    return joined.select("job_id", status.alias("status"))


def rebuilt(before: DataFrame, after: DataFrame) -> DataFrame:
    """What detecting again says: findings no longer found are fixed, new ones are appended open. Keys are (job, kind, location)."""
    key = ["job_id", "kind", "location"]
    found = after.select(*key).distinct()
    kept = before.join(found.withColumn("__still", F.lit(True)), key, "left")
    kept = kept.withColumn("remediated", F.col("remediated") | F.col("__still").isNull()).drop("__still").withColumn("origin", F.lit("before"))
    new = after.join(before.select(*key).distinct(), key, "left_anti").withColumn("origin", F.lit("new"))
    return kept.unionByName(new)
