"""Inputs of the rules, derived from the given tables by fixed formulas.

The tables hold no office documents, so each rule's input columns come from theirs: what a rule computes is then checked
at scale, against SQL over the same formulas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioworks.functions import colour
from folioworks.plans import catalog
from folioworks.tables import table

BACKGROUNDS = (16777215, 0, 16776960, 8421504)
NOW = "1997-06-01 00:00:00"
#: Sentences added to documents, by doc_id modulo their number; texts of the tables hold none of what the rules look for.
PHRASES = (
    "Click the button on the left to continue.",
    "Required fields are marked in red.",
    "Press the round icon when you hear a tone.",
    "Green, amber or red shows the status.",
    "The chart is on the wall.",
    "He said “keep this to yourself” and left.",
    "Select the largest box, then submit it.",
)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as painted runs: a page for each order, its lines in a total order."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").withColumn("ord", F.row_number().over(order))
    return rows.select(
        F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), "ord", F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("text"),
        F.col("l_quantity").alias("points"), (F.col("l_returnflag") == "R").alias("bold"), (0.5 + 2 * F.col("l_discount")).alias("share"),
        colour.from_number(F.col("l_partkey") * 7919 % 16777216).alias("fg"), colour.from_number(F.get(F.array(*map(F.lit, BACKGROUNDS)), (F.col("l_suppkey") % 4).cast("int"))).alias("bg"),
        "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus",
    )


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as findings: a job for each order, a finding for each line."""
    names = F.array(*[F.lit(k) for k, _ in catalog.KINDS])
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("seq"), F.get(names, (F.col("l_partkey") % len(catalog.KINDS)).cast("int")).alias("kind"),
        F.when(F.col("l_quantity") < 5, "blocking").otherwise("partial").alias("severity"), (F.col("l_linestatus") == "F").alias("remediated"),
        F.when(F.col("l_returnflag") == "A", "dismiss").alias("action"), F.concat(F.lit("page "), (F.col("l_suppkey") % 9).cast("string")).alias("location"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as jobs."""
    o = table(spark, sf_dir, "orders")
    day = F.col("o_orderdate").cast("timestamp")
    text = lambda t: F.date_format(t, "yyyy-MM-dd HH:mm:ss")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("job_id"), F.when(k % 2 == 0, "docx").otherwise("pdf").alias("format"), F.when(k % 11 == 0, "not a date").otherwise(text(day)).alias("created_at"),
        F.when(F.col("o_orderstatus") == "P", text(day + F.expr("INTERVAL 1 DAY"))).alias("remediated_at"), F.when(F.col("o_orderpriority").startswith("1"), F.lit("reviewer")).alias("reviewer"),
        F.when(k % 7 == 0, text(day + F.expr("INTERVAL 7 DAYS"))).alias("delete_after"), (k % 7 == 0).alias("delivered"),
        F.when(k % 3 == 0, F.col("o_custkey")).alias("account"), F.when(k % 3 == 1, F.col("o_custkey")).alias("visitor"),
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as facts of PDFs."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("job_id"), (k % 5).cast("int").alias("pages"), F.when(k % 4 == 0, k % 5).otherwise(0).cast("int").alias("textless"), (k % 3 != 0).alias("tagged"),
        (F.col("o_custkey") % 4).cast("int").alias("headings"), (F.col("o_custkey") % 17).cast("int").alias("undescribed"), (F.col("o_custkey") % 5).cast("int").alias("raster_images"),
    )


def phrased(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with one more sentence."""
    more = F.get(F.array(*map(F.lit, PHRASES)), (F.col("doc_id") % len(PHRASES)).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.concat("text", F.lit(" "), more).alias("text"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as placed blocks: corners from its numbers."""
    r = runs(spark, sf_dir)
    left = F.col("l_partkey") % 3 * 330.0 + F.col("l_suppkey") % 5
    top = F.col("l_quantity") * 10.0
    return r.select("doc_id", "page", "ord", "text", F.lit(1000.0).alias("width"), top.alias("top"), (top + 12 + F.col("l_suppkey") % 3).alias("bottom"), left.alias("left"), (left + 250 + F.col("l_suppkey") % 40).alias("right"))
