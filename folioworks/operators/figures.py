"""Where the picture of a figure lies in a Word archive: drawings met with relationships, targets resolved as paths.

drawings: doc_id, anchor (docPr:<id>), pre, embed (of the first picture embedded in it, if any). relations: doc_id, id, target, mode, ord. A
figure that can't be had has a reason: `none` embedded, `unknown` relation, no `target`, `external`, `type` that is no picture for the web.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks.operators import word
from folioworks.sources import trees

RELATIONS = "word/_rels/document.xml.rels"
# Media types by ending.
TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "jpe": "image/jpeg", "gif": "image/gif", "webp": "image/webp"}


def resolved(path: Column) -> Column:
    """A path without `.` and empty parts, each `..` taking back the part before it, if there is one."""
    step = lambda out, p: F.when(p.isin("", "."), out).when(p == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(p)))
    return F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step, lambda out: F.array_join(out, "/"))


def figure_sources(drawings: DataFrame, relations: DataFrame) -> DataFrame:
    """doc_id, anchor, part, media_type, reason: one row for each anchor, of its first drawing; of relations of one id the first counts."""
    first = drawings.groupBy("doc_id", "anchor").agg(F.min_by("embed", "pre").alias("embed"))
    known = relations.groupBy("doc_id", F.col("id").alias("embed")).agg(F.min_by(F.struct("target", "mode"), "ord").alias("to"))
    met = first.join(known, ["doc_id", "embed"], "left")
    target = F.col("to.target")
    outside = F.coalesce(target.rlike("(?i)^[a-z]+://"), F.lit(False)) | F.coalesce(F.col("to.mode") == "External", F.lit(False))
    part = F.when(target.startswith("/"), F.substring(target, 2, 1 << 30)).otherwise(F.concat(F.lit("word/"), target))
    ending = F.lower(F.element_at(F.split(part, r"\."), -1))
    media = F.try_element_at(F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv]), ending)
    reason = F.when(F.coalesce("embed", F.lit("")) == "", "none").when(F.col("to").isNull(), "unknown").when(F.coalesce(target, F.lit("")) == "", "target").when(outside, "external").when(media.isNull(), "type")
    return met.select("doc_id", "anchor", F.when(reason.isNull(), resolved(part)).alias("part"), F.when(reason.isNull(), media).alias("media_type"), reason.alias("reason"))


def of_trees(read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drawings and relations of documents, from their trees (`sources.trees`)."""
    nodes = trees.nodes(read)
    body = word.body_of(nodes, "doc_id").where("figure is not null")
    of = lambda name, a: F.min_by(F.when((F.col("name") == name) & (F.coalesce(word.attr(a), F.lit("")) != ""), word.attr(a)), F.when((F.col("name") == name) & (F.coalesce(word.attr(a), F.lit("")) != ""), F.col("pre")))
    drawings = body.groupBy("doc_id", F.col("figure").alias("pre")).agg(of("docPr", "id").alias("id"), of("blip", "embed").alias("embed"))
    relations = nodes.where((F.col("part") == RELATIONS) & (F.col("name") == "Relationship")).select("doc_id", word.attr("Id").alias("id"), word.attr("Target").alias("target"), word.attr("TargetMode").alias("mode"), F.col("pre").alias("ord"))
    return drawings.where("id is not null").select("doc_id", F.concat(F.lit("docPr:"), "id").alias("anchor"), "pre", "embed"), relations
