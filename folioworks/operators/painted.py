"""Rules on pages as painted: runs with ink and paper, and placed blocks. All are windows by document and page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioworks.functions import colour

# Least share of one background, share of the width that is a gutter, blocks of a column, same ink, same size.
SOLID, GUTTER, COLUMN_BLOCKS, SAME_INK, SAME_SIZE = 0.6, 0.04, 3, 24, 1.5


def readable(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]")) >= 2


def contrast_findings(runs: DataFrame) -> DataFrame:
    """`runs`: doc_id, page, ord, text, points, bold, fg, bg (structs, null if unknown), share.

    One row for each page with a run that can't be measured, and for each page and pair of colours below the minimum: the
    first run in order. Later runs of a key fall in an aggregate that combines before it shuffles.
    """
    known = runs.where(readable(F.trim("text")))
    measured = F.col("fg").isNotNull() & F.col("bg").isNotNull() & (F.col("share") >= SOLID)
    ratio = F.when(measured, colour.contrast(F.col("fg"), F.col("bg")))
    least = colour.minimum_ratio(F.col("points"), F.col("bold"))
    judged = known.select(
        "doc_id", "page", "ord", "text", least.alias("minimum"), ratio.alias("ratio"),
        F.when(measured, colour.to_hex(F.col("fg"))).alias("fg"), F.when(measured, colour.to_hex(F.col("bg"))).alias("bg"),
    )
    failing = judged.where(F.col("ratio").isNull() | (F.col("ratio") < F.col("minimum")))
    first = failing.groupBy("doc_id", "page", "fg", "bg").agg(F.min(F.struct("ord", "text", "ratio", "minimum")).alias("run"))
    return first.select("doc_id", "page", "fg", "bg", "run.ord", "run.text", "run.ratio", "run.minimum")


def first_inversions(blocks: DataFrame) -> DataFrame:
    """By page, the first block that is read after another but lies above it by more than half a line."""
    page = Window.partitionBy("doc_id", "page")
    order = page.orderBy("ord")
    height = F.abs(F.col("bottom") - F.col("top"))
    # The upper median of heights.
    held = blocks.withColumn("__n", F.count("*").over(page)).withColumn("__k", F.row_number().over(page.orderBy(height, "ord"))).withColumn("__h", height)
    held = held.withColumn("__gap", F.max(F.when(F.col("__k") == F.floor(F.col("__n") / 2) + 1, F.col("__h"))).over(page) / 2)
    deepest = F.max(F.struct("top", (-F.col("ord")).alias("o"), "ord")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    found = held.withColumn("__deep", deepest).where(F.col("bottom") < F.col("__deep.top") - F.col("__gap"))
    pair = F.struct(F.col("ord").alias("later"), F.col("__deep.ord").alias("earlier"))
    return found.groupBy("doc_id", "page").agg(F.min(pair).alias("x")).select("doc_id", "page", "x.earlier", "x.later")


def count_columns(blocks: DataFrame) -> DataFrame:
    """By page: columns, told apart by gutters with enough blocks on either side. `blocks` has width, left and right."""
    page = Window.partitionBy("doc_id", "page")
    low, high = F.least("left", "right"), F.greatest("left", "right")
    spans = blocks.select("doc_id", "page", "width", low.alias("low"), high.alias("high"), ((F.col("left") + F.col("right")) / 2).alias("centre"))
    order = page.orderBy("low", "high")
    reached = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("reached", reached)
    gaps = spans.where(F.col("low") > F.col("reached")).where((F.col("low") - F.col("reached")) / F.col("width") >= GUTTER).where("width > 0")
    gaps = gaps.select("doc_id", "page", F.col("reached").alias("edge"))
    sides = gaps.join(spans.select("doc_id", "page", "centre"), ["doc_id", "page"]).groupBy("doc_id", "page", "edge").agg(
        F.count_if(F.col("centre") <= F.col("edge")).alias("before"), F.count_if(F.col("centre") > F.col("edge")).alias("after")
    )
    columns = sides.where((F.col("before") >= COLUMN_BLOCKS) & (F.col("after") >= COLUMN_BLOCKS)).groupBy("doc_id", "page").agg((F.count("*") + 1).alias("columns"))
    pages = blocks.select("doc_id", "page").distinct()
    return pages.join(columns, ["doc_id", "page"], "left").select("doc_id", "page", F.coalesce("columns", F.lit(1)).cast("long").alias("columns"))


def line_numbers(runs: DataFrame) -> DataFrame:
    """Adds `line`: runs share one if they overlap the run before by more than half of the shorter."""
    order = Window.partitionBy("doc_id", "page").orderBy("top", "left", "ord")
    last_top, last_bottom = F.lag("top").over(order), F.lag("bottom").over(order)
    held = runs.withColumn("__overlap", F.least(last_bottom, F.col("bottom")) - F.greatest(last_top, F.col("top"))).withColumn("__shorter", F.least(last_bottom - last_top, F.col("bottom") - F.col("top")))
    same = last_top.isNotNull() & F.coalesce((F.col("__shorter") > 0) & (F.col("__overlap") / F.col("__shorter") > 0.5), F.lit(False))
    held = held.withColumn("__new", F.when(same, 0).otherwise(1))
    return held.withColumn("line", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__overlap", "__shorter", "__new")


def dominant_ink(runs: DataFrame) -> DataFrame:
    """By line with more than one ink: the ink that carries most text, ties to the first. `runs` has line, fg, text."""
    bucket = F.concat_ws(",", *[F.round(F.col(f"fg.{c}") / SAME_INK).cast("int").cast("string") for c in "rgb"])
    inks = runs.where("fg is not null").groupBy("doc_id", "page", "line", bucket.alias("bucket")).agg(F.sum(F.length(F.trim("text"))).alias("weight"), F.min("place").alias("first"), F.min(F.struct("place", "fg", "points")).alias("run"))
    best = inks.groupBy("doc_id", "page", "line").agg(F.count("*").alias("inks"), F.max(F.struct("weight", (-F.col("first")).alias("o"), F.col("run.fg").alias("fg"), F.col("run.points").alias("points"))).alias("ink"))
    return best.where("inks > 1").select("doc_id", "page", "line", F.col("ink.fg").alias("ink"), F.col("ink.points").alias("ink_points"))


def colour_only_findings(runs: DataFrame) -> DataFrame:
    """By page and colour, the first run that only colour sets apart from its line."""
    lined = line_numbers(runs.where(readable(F.col("text")) & F.col("fg").isNotNull()))
    lined = lined.withColumn("place", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("top", "left", "ord")))
    joined = lined.join(dominant_ink(lined), ["doc_id", "page", "line"])
    unlike = F.greatest(*[F.abs(F.col(f"fg.{c}") - F.col(f"ink.{c}")) for c in "rgb"]) > SAME_INK
    apart = joined.where(unlike & (F.abs(F.col("points") - F.col("ink_points")) <= SAME_SIZE) & ~F.col("bold"))
    first = apart.groupBy("doc_id", "page", colour.to_hex(F.col("fg")).alias("fg")).agg(F.min(F.struct("place", "ord")).alias("x"))
    return first.select("doc_id", "page", "fg", F.col("x.ord").alias("ord"))


def paper_and_ink(pixels: DataFrame, least: int = 2, least_share: float = 0.02) -> DataFrame:
    """By run: mean colour and share of the commonest bucket of colours (4 bits a channel), and the ink: of the buckets with
    enough pixels the one whose luminance is furthest from it. `pixels`: run_id, r, g, b."""
    four = [F.shiftright(c, 4).alias(f"q{c}") for c in "rgb"]
    buckets = pixels.groupBy("run_id", *four).agg(F.count("*").alias("n"), *[F.round(F.avg(c)).cast("int").alias(c) for c in "rgb"])
    code = F.col("qr") * 256 + F.col("qg") * 16 + F.col("qb")
    buckets = buckets.select("run_id", "n", code.alias("code"), F.struct("r", "g", "b").alias("c"))
    paper = buckets.groupBy("run_id").agg(F.sum("n").alias("pixels"), F.max(F.struct("n", (-F.col("code")).alias("o"), "c", "code")).alias("p"))
    inks = buckets.join(paper, "run_id").where((F.col("code") != F.col("p.code")) & (F.col("n") >= F.greatest(F.lit(least), F.col("pixels") * least_share)))
    far = F.abs(colour.luminance(F.col("c")) - colour.luminance(F.col("p.c")))
    ink = inks.groupBy("run_id").agg(F.max(F.struct(F.round(far, 9).alias("far"), (-F.col("code")).alias("o"), "c")).alias("i"))
    out = paper.join(ink, "run_id", "left")
    return out.select("run_id", colour.to_hex(F.col("p.c")).alias("paper"), (F.col("p.n") / F.col("pixels")).alias("share"), F.when(F.col("i").isNotNull(), colour.to_hex(F.col("i.c"))).alias("ink"))
