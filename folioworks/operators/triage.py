"""Triage of PDFs and prices, as expressions over facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tiers in order; prices in cents; figures that a price includes.
TIERS = ("scan", "untagged", "tagged", "structured")
STATEMENT, CERTIFIABLE, PARTIAL, FIGURE, INCLUDED = 4900, 14900, 9900, 300, 10
OFFERS = ("assessment", "statement", "remediation")


def tier(pages: Column, textless: Column, tagged: Column, headings: Column) -> Column:
    return F.when((pages > 0) & (textless == pages), "scan").when(~tagged, "untagged").when(headings > 0, "structured").otherwise("tagged")


def counts_by_tier(facts: DataFrame) -> DataFrame:
    """One row with a count for each tier, zero where there is none."""
    return facts.agg(*[F.count_if(F.col("tier") == t).alias(t) for t in TIERS], F.round(F.coalesce(F.count_if(F.col("tier").isin("tagged", "structured")) * 100 / F.count("*"), F.lit(0.0))).cast("long").alias("certifiable_percent"))


def figures_mix(facts: DataFrame) -> DataFrame:
    """Documents with undescribed figures, those of them with raster images that could be sent, and all figures that wait."""
    needs, can = F.col("undescribed") > 0, F.col("raster_images") > 0
    return facts.agg(F.count_if(needs).alias("needing"), F.count_if(needs & can).alias("draftable"), F.coalesce(F.sum(F.when(needs, F.col("undescribed"))), F.lit(0)).alias("figures"))


def reach(fmt: Column, tier_: Column) -> Column:
    return F.when(fmt == "docx", "most").when(tier_ == "untagged", "metadata").when(tier_ == "tagged", "figures").when(tier_ == "structured", "most").otherwise("nothing")


def quotes(work: DataFrame) -> DataFrame:
    """`work`: job_id, format, tier, figures. Three rows each: offer, available, cents and extra figures."""
    offered = work.withColumn("reach", reach(F.col("format"), F.col("tier"))).withColumn("offer", F.explode(F.array(*map(F.lit, OFFERS))))
    free, statement = F.col("offer") == "assessment", F.col("offer") == "statement"
    refused = ~free & ((F.col("reach") == "nothing") | (~statement & (F.col("reach") == "metadata")))
    extra = F.greatest(F.lit(0), F.col("figures") - INCLUDED).cast("long")
    base = F.when(F.col("reach") == "most", CERTIFIABLE).otherwise(PARTIAL)
    cents = F.when(refused, None).when(free, 0).when(statement, STATEMENT).otherwise(base + extra * FIGURE).cast("long")
    caveat = ~refused & ~free & (F.col("reach") != "most")
    return offered.select("job_id", "offer", (~refused).alias("available"), cents.alias("cents"), F.when(~refused & ~free & ~statement, extra).otherwise(0).cast("long").alias("extra_figures"), caveat.alias("caveat"))


def best_offers(quoted: DataFrame) -> DataFrame:
    """By job, remediation if it is sold, else the statement, else the assessment."""
    rank = F.array_position(F.array(*map(F.lit, OFFERS)), F.col("offer"))
    best = F.max(F.when(F.col("available"), F.struct(rank.alias("rank"), "offer", "cents")))
    return quoted.groupBy("job_id").agg(best.alias("b")).select("job_id", "b.offer", "b.cents")
