"""Reading order of tagged PDFs: marked content in the order of the tag tree, met with what is painted on pages.

refs: the tag tree's references to marked content in order. runs: what is painted, with the stack of marked content that is
open there. A run belongs to the innermost identifier of its stack; runs of one identifier on a page grow one block, whose
place is the last reference to it; runs that no tag refers to have no place. Everything is keyed by (document, page,
identifier): no page and no document is gathered, but for the windows by page of `painted`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioworks.functions.text import snippet
from folioworks.operators import painted
from folioworks.scans import numbered

# Fixed value: length of quotations.
QUOTED = 40
MARK = ["doc_id", "page", "mcid"]


def marked_refs(elements: DataFrame) -> DataFrame:
    """doc_id, page, mcid, ord: references in reading order.

    elements: doc_id, pre, page (its own; null takes that of the element around it, `above`), above, marks: array of (mcid, page); a
    mark's own page comes first. References without any page are left out, and don't count.
    """
    each = elements.select("doc_id", "pre", F.posexplode("marks").alias("i", "m"), F.coalesce("page", "above").alias("here"))
    known = each.select("doc_id", "pre", "i", F.coalesce("m.page", "here").alias("page"), F.col("m.mcid").alias("mcid")).where("page is not null and mcid is not null")
    return numbered(known, ["doc_id"], ["pre", "i"]).select(*MARK, F.col("rank").alias("ord"))


def placed_blocks(refs: DataFrame, runs: DataFrame) -> DataFrame:
    """doc_id, page, mcid, width, ord, text, top, bottom, left, right: blocks of runs with one identifier.

    runs: doc_id, page, width, ord, text, open (array of identifiers, innermost last; nulls are content without one), top, bottom, left,
    right. Blank runs and runs outside marked content are left out; texts are joined in the order of painting.
    """
    last = refs.groupBy(*MARK).agg(F.max("ord").alias("place"))
    inner = F.element_at(F.filter("open", lambda m: m.isNotNull()), -1)
    held = runs.where((F.size("open") > 0) & (F.trim("text") != "")).withColumn("mcid", F.when(F.size(F.filter("open", lambda m: m.isNotNull())) > 0, inner)).where("mcid is not null")
    texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda t: t["text"]), " ")
    blocks = held.groupBy(*MARK).agg(F.max("width").alias("width"), texts.alias("text"), *[f(c).alias(c) for f, c in ((F.min, "top"), (F.max, "bottom"), (F.min, "left"), (F.max, "right"))])
    return blocks.join(last, MARK).select(*MARK, "width", F.col("place").alias("ord"), "text", "top", "bottom", "left", "right")


def sequence_findings(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, page (null for a whole document), severity, reason, columns, earlier, later: what speaks against a document's reading order.

    docs: doc_id, tagged. An untagged document has none at all; one of which no block can be read could not be compared; else
    a page of several columns has to be looked at, and one of a single column is searched for a block that is read too late.
    """
    read = blocks.where(painted.readable(F.col("text")))
    none = lambda kind: F.lit(None).cast(kind)
    seen = read.select("doc_id").distinct().withColumn("seen", F.lit(True))
    told = docs.join(seen, "doc_id", "left")
    whole = told.where(~F.col("tagged") | F.col("seen").isNull()).select(
        "doc_id", none("int").alias("page"), F.when(F.col("tagged"), "partial").otherwise("blocking").alias("severity"), F.when(F.col("tagged"), "unmatched").otherwise("untagged").alias("reason"), none("long").alias("columns"), none("string").alias("earlier"), none("string").alias("later")
    )
    pages = read.join(docs.where("tagged").select("doc_id"), "doc_id", "left_semi")
    several = pages.withColumn("n", F.count("*").over(Window.partitionBy("doc_id", "page"))).where("n > 1").drop("n")
    counted = painted.count_columns(several)
    wide = counted.where("columns > 1").select("doc_id", "page", F.lit("partial").alias("severity"), F.lit("columns").alias("reason"), "columns", none("string").alias("earlier"), none("string").alias("later"))
    single = several.join(counted.where("columns = 1").select("doc_id", "page"), ["doc_id", "page"], "left_semi")
    quoted = single.select("doc_id", "page", "ord", snippet(F.col("text"), QUOTED).alias("said"))
    text = lambda n: quoted.select("doc_id", "page", F.col("ord").alias(n), F.col("said").alias(f"{n}_said"))
    turned = painted.first_inversions(single).join(text("earlier"), ["doc_id", "page", "earlier"]).join(text("later"), ["doc_id", "page", "later"])
    turned = turned.select("doc_id", "page", F.lit("partial").alias("severity"), F.lit("inverted").alias("reason"), none("long").alias("columns"), F.col("earlier_said").alias("earlier"), F.col("later_said").alias("later"))
    return whole.unionByName(wide).unionByName(turned)
