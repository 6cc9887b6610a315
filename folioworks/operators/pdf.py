"""Findings of PDF documents, from their facts, tag trees and annotations.

* facts: doc_id, tagged, language, title, display_title, pages, pages_without_text, pages_with_graphics (arrays), fields
* elements: doc_id, pre, last, parent (0 for none), tag, num, page, alt, actual_text; b is below a if a.pre < b.pre <= a.last
* roles: doc_id, tag, mapped; annotations: doc_id, page, ord, subtype, contents, uri

An untagged document has no findings that need tags. A tree is at most DEPTH deep, as readers cut it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioworks.functions.text import squeezed
from folioworks.operators.word import ADDRESS, GENERIC_LINK, found
from folioworks.tables import stored

# Fixed value: paragraphs from which on a PDF needs headings; fewer than in Word, and blank ones count.
ENOUGH_PARAGRAPHS = 6
# Hops from a tag to its role, and depth of a tree.
HOPS, DEPTH = 8, 64
KEY = "doc_id"


def with_roles(elements: DataFrame, roles: DataFrame) -> DataFrame:
    """Adds role: where the document's map leads from the tag, until it leads nowhere or to itself."""
    maps = roles.groupBy(KEY, "tag").agg(F.max("mapped").alias("mapped")).groupBy(KEY).agg(F.map_from_entries(F.collect_list(F.struct("tag", "mapped"))).alias("__map"))
    hop = lambda tag, _: F.coalesce(F.try_element_at("__map", tag), tag)
    role = F.when(F.col("__map").isNull(), F.col("tag")).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(HOPS)), F.col("tag"), hop))
    return elements.join(maps, KEY, "left").withColumn("role", role).drop("__map")


def with_pages(elements: DataFrame) -> DataFrame:
    """Elements without a page take that of the nearest element around them; pointers double, so rounds follow the depth's logarithm.

    Only what is still open goes through a round, as its number and pointer, and a round is written, so that the next one
    does not carry it out again; rounds end when nothing is open.
    """
    own = elements.where("page is not null").select(KEY, F.col("pre").alias("up"), F.col("page").alias("found"), F.lit(0).alias("next"))
    open_ = stored(elements.where("page is null and parent != 0").select(KEY, "pre", F.col("parent").alias("up")), "pdf-open")
    done = []
    for _ in range(DEPTH.bit_length()):
        if open_.isEmpty():
            break
        around = own.unionByName(open_.select(KEY, F.col("pre").alias("up"), F.lit(None).cast("int").alias("found"), F.col("up").alias("next")), allowMissingColumns=True)
        met = stored(open_.join(around, [KEY, "up"]).where("found is not null or next != 0"), "pdf-pages")
        done.append(met.where("found is not null").select(KEY, "pre", "found"))
        own = own.unionByName(done[-1].select(KEY, F.col("pre").alias("up"), "found", F.lit(0).alias("next")))
        open_ = met.where("found is null").select(KEY, "pre", F.col("next").alias("up"))
    if not done:
        return elements
    return elements.join(reduce(DataFrame.union, done), [KEY, "pre"], "left").withColumn("page", F.coalesce("page", "found")).drop("found")


def documents(facts: DataFrame) -> list[DataFrame]:
    """What a whole document lacks: title, language, text, tags."""
    f = facts.withColumn("p", F.lit(0))
    titled, blank = squeezed(F.coalesce("title", F.lit(""))) != "", squeezed(F.coalesce("language", F.lit(""))) == ""
    without, drawn = F.size("pages_without_text"), F.size("pages_with_graphics") > 0
    pages = F.when(without == F.col("pages"), F.concat(F.lit("all "), F.col("pages").cast("string"), F.when(F.col("pages") == 1, " page").otherwise(" pages"))).otherwise(F.concat(F.lit("pages "), F.concat_ws(", ", F.col("pages_without_text").cast("array<string>"))))
    properties, whole = F.lit("document properties"), F.lit("whole document")
    shown = F.coalesce("display_title", F.lit(False))
    bare = f.where(~F.coalesce("tagged", F.lit(False)))
    return [
        found(f.where(~titled), KEY, 1, "no-title", properties, severity="blocking"),
        found(f.where(titled & ~shown), KEY, 1, "pdf-title-not-shown", properties, detail=F.col("title")),
        found(f.where(blank), KEY, 2, "no-language", F.lit("document catalogue"), severity="blocking"),
        found(f.where((without > 0) & drawn), KEY, 3, "pdf-no-text", pages, severity="blocking"),
        found(bare, KEY, 4, "pdf-untagged", whole, severity="blocking"),
        found(bare.where((without == 0) & drawn), KEY, 5, "image-alt", whole, severity="blocking"),
    ]


def detect(facts: DataFrame, elements: DataFrame, roles: DataFrame, annotations: DataFrame) -> DataFrame:
    """doc_id, seq, kind, location, severity, anchor, detail: all findings, in the order of rules and places."""
    tagged = facts.where("tagged").select(KEY, "fields")
    # Elements are written before pages are looked for: every round reads them.
    tree = stored(with_pages(stored(with_roles(elements.join(tagged.select(KEY), KEY, "left_semi"), roles), "pdf-roles")), "pdf-elements")
    at = F.coalesce(F.concat(F.lit("page "), F.col("page").cast("string")), F.lit("the document"))
    order = Window.partitionBy(KEY).orderBy("pre")
    n = F.row_number().over(order).cast("string")

    told = lambda name: squeezed(F.coalesce(name, F.lit(""))) != ""
    figures = tree.where("role in ('Figure', 'Formula')").withColumn("n", n).where(~told("alt") & ~told("actual_text"))
    heads = tree.where(F.col("role").rlike("^H[1-6]?$")).withColumn("numbered", F.when(F.col("role") != "H", F.substring("role", 2, 1).cast("int")))
    heads = heads.withColumn("level", F.coalesce(F.last("numbered", ignorenulls=True).over(order), F.lit(1))).withColumn("before", F.lag("level").over(order))
    skips = heads.where("level > before + 1")
    plain = tree.where(F.col("role").rlike("^H[1-6]?$") | (F.col("role") == "P")).groupBy(KEY).agg(F.count_if(F.col("role") == "P").alias("p"), F.count_if(F.col("role") != "P").alias("heads")).where(f"heads = 0 and p >= {ENOUGH_PARAGRAPHS}")

    # Cells below a table: counts up to its last element less counts up to itself.
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    counts = tree.select(KEY, "pre", "last", "page", "role", F.count_if(F.col("role") == "TH").over(upto).alias("th"), F.count_if(F.col("role") == "TD").over(upto).alias("td"))
    ends = counts.select(KEY, F.col("pre").alias("last"), F.col("th").alias("th_end"), F.col("td").alias("td_end"))
    tables = counts.where("role = 'Table'").withColumn("n", n).join(ends, [KEY, "last"]).where("th_end = th and td_end > td")

    place = Window.partitionBy(KEY).orderBy("page", "ord")
    notes = annotations.join(tagged.select(KEY), KEY, "left_semi")
    label = squeezed(F.coalesce("contents", F.lit("")))
    links = notes.where("subtype = 'Link'").withColumn("n", F.row_number().over(place)).where((label == "") | label.rlike(GENERIC_LINK) | label.rlike(ADDRESS))
    media = notes.where("subtype in ('Screen', 'Movie')").withColumn("n", F.row_number().over(place))
    forms = tagged.where("fields > 0").withColumn("p", F.lit(0))
    numbered = lambda what, where: F.concat(F.lit(f"{what} "), F.col("n").cast("string"), F.lit(", "), where)
    page: Column = F.concat(F.lit("page "), F.col("page").cast("string"))
    rows = [
        *documents(facts),
        found(figures, KEY, 5, "image-alt", numbered("figure", at), "pre", anchor=F.concat(F.lit("struct:"), F.col("num").cast("string"))),
        found(plain, KEY, 6, "no-headings", F.lit("whole document"), detail=F.col("p").cast("string")),
        found(skips, KEY, 7, "heading-skip", at, "pre", detail=F.concat(F.col("level").cast("string"), F.lit(" after "), F.col("before").cast("string"))),
        found(tables, KEY, 8, "table-header", numbered("table", at), "pre"),
        found(links, KEY, 9, "link-text", numbered("link", page), "n", detail=F.coalesce(F.nullif(label, F.lit("")), F.col("uri"))),
        found(media, KEY, 10, "media", page, "n"),
        found(forms, KEY, 11, "forms", F.concat(F.col("fields").cast("string"), F.when(F.col("fields") == 1, " field").otherwise(" fields"))),
    ]
    seq = F.row_number().over(Window.partitionBy(KEY).orderBy("rule", "place", "nth"))
    return reduce(DataFrame.union, rows).select(KEY, seq.cast("long").alias("seq"), "kind", "location", "severity", "anchor", "detail")
