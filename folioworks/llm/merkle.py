"""A manifest of a dataset as a content-addressed Merkle DAG, with a membership proof for every row.

Rows are leaves, ordered by id within their group; every ARITY consecutive nodes become one node, whose digest is that of
their digests, until a group has one node, its subroot; the subroots, ordered by group, give the root in the same way.
The store is a table for each height with records digest -> children, one for each digest: equal subtrees are kept once.

Proofs come from a descent. A leaf asks for its path by its group and rank: the digits of the rank, the highest first,
say which child to take at each height, and the children that are not taken are the path's segment there. Leaves with a
common beginning of their digits descend together, as one row, and part only where their digits do, so a height has as many
rows as it has nodes and no key is met by more. At the end the segments are reversed, to go from the leaf to the root.

Ranks are counted by ranges of (group, id, digest), so a group that holds most rows is many tasks; of documents, only
digests are shuffled. All tables between steps are written to the shared folder.

Defined cases: nulls are `-` in a leaf, a null group is a group of its own and comes first, null ids come first; rows equal
in id and group are ordered by their digest, whole copies are leaves of their own with one digest; an empty text differs
from a null; an empty table has no rows; columns that are not named are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks.scans import numbered
from folioworks.tables import stored

ARITY = 8


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def field(value: Column) -> Column:
    """`-` for a null, else the length in bytes of UTF-8, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return digest(F.concat(*map(field, values)))


@dataclass
class Trees:
    """Trees by `tree`. heights[h]: tree, no, digest, count, children of the nodes h above the leaves; tops: tree, digest, height."""

    heights: list[DataFrame]
    tops: DataFrame


def grown(leaves: DataFrame) -> Trees:
    """Trees over leaves (tree, rank, total, digest). A tree of one leaf is that leaf."""
    nodes = leaves.select("tree", F.col("rank").alias("no"), "digest", F.col("total").alias("count"), F.lit(None).cast("array<string>").alias("children"))
    most, heights = leaves.agg(F.max("total")).head()[0] or 0, [nodes]
    while most > 1:
        below = heights[-1].where(F.col("count") > 1)
        runs = below.groupBy("tree", F.floor(F.col("no") / ARITY).alias("no"), F.ceil(F.col("count") / ARITY).alias("count")).agg(F.sort_array(F.collect_list(F.struct(F.col("no").alias("at"), "digest"))).alias("run"))
        children = F.transform("run", lambda n: n["digest"])
        heights.append(stored(runs.select("tree", "no", digest(F.array_join(children, "")).alias("digest"), "count", children.alias("children")), "nodes"))
        most = -(-most // ARITY)
    tops = [h.where(F.col("count") == 1).select("tree", "digest", F.lit(i).alias("height")) for i, h in enumerate(heights)]
    top = tops[0]
    for t in tops[1:]:
        top = top.unionByName(t)
    return Trees(heights, stored(top, "tops"))


def segment(children: Column, digit: Column) -> Column:
    """What a child's digest stands between: the digests left and right of it."""
    left = F.array_join(F.slice(children, 1, digit), "")
    right = F.array_join(F.slice(children, digit + 2, F.size(children)), "")
    return F.struct(left.alias("left"), right.alias("right"))


def descended(trees: Trees, tops: DataFrame) -> DataFrame:
    """Requests at the nodes above the leaves: tree, no, about, height (1, or 0 where a tree is a leaf), path, children.

    `tops` has tree, digest, height, path, the segments taken so far, from the root down, and about, which is handed on. The
    digits of a rank are its digits to the base of the arity; what is above a node is fixed by its number, so requests for
    one node are one row.
    """
    first = F.lit(0).cast("long").alias("no")
    taken = tops.where("height = 0").select("tree", first, "about", F.lit(0).alias("height"), "path", F.array("digest").alias("children"))
    at = None
    for height in range(len(trees.heights) - 1, 0, -1):
        entering = tops.where(F.col("height") == height).select("tree", first, "digest", "about", "path")
        at = entering if at is None else at.unionByName(entering)
        records = trees.heights[height].groupBy("digest").agg(F.first("children").alias("children"))
        met = at.join(records, "digest")
        if height == 1:
            return taken.unionByName(met.select("tree", "no", "about", F.lit(1).alias("height"), "path", "children"))
        child = met.select("tree", "no", "about", "path", "children", F.posexplode("children").alias("digit", "child"))
        at = child.select("tree", (F.col("no") * ARITY + F.col("digit")).alias("no"), F.col("child").alias("digest"), "about", F.concat("path", F.array(segment(F.col("children"), F.col("digit")))).alias("path"))
    return taken


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest gives with the segments of a path, from the leaf up."""
    return F.aggregate(path, leaf, lambda acc, s: digest(F.concat(s["left"], acc, s["right"])))


def manifest(rows: DataFrame, group: str, order: str, values: list[str], altered: Column | None = None) -> DataFrame:
    """For each row: `order`, leaf, subroot, root, path (from the leaf up: left and right digests by height), altered_leaf.

    Leaves are digests of `values`. `altered`, a text column, gives the digest that a row would have with its last value
    altered (null: not altered); a row whose path doesn't lead from it to the root is found out.
    """
    other = F.lit(None).cast("string") if altered is None else F.when(altered.isNotNull(), leaf_digest(*[F.col(v) for v in values[:-1]], altered))
    leaves = stored(rows.select(F.col(group).alias("tree"), F.col(order).alias("id"), leaf_digest(*map(F.col, values)).alias("digest"), other.alias("altered_leaf")), "leaves")
    ranked = stored(numbered(leaves, ["tree"], ["id", "digest"]), "ranked")
    trees = grown(ranked)
    # The groups' subroots, in order, are the leaves of one more tree.
    above = stored(numbered(trees.tops.withColumn("all", F.lit(0)), ["all"], ["tree"]), "groups")
    over = grown(above.select(F.col("all").alias("tree"), "rank", "total", "digest"))
    empty = F.array().cast("array<struct<left:string,right:string>>")
    digit_of = F.when(F.col("height") == 0, 0).otherwise(F.col("no") * ARITY) + F.col("digit")
    steps = F.when(F.col("height") == 0, F.col("path")).otherwise(F.concat("path", F.array(segment(F.col("children"), F.col("digit")))))
    roots = descended(over, over.tops.select("tree", "digest", "height", empty.alias("path"), F.col("digest").alias("about")))
    roots = roots.select("no", "height", "path", "children", "about", F.posexplode("children").alias("digit", "child")).select(digit_of.cast("long").alias("rank"), steps.alias("path"), F.col("about").alias("root"))
    tops = above.join(roots, "rank").select("tree", "digest", "height", "path", F.struct(F.col("digest").alias("subroot"), "root").alias("about"))
    at = descended(trees, stored(tops, "entries"))
    asked = ranked.groupBy(F.col("tree").alias("of"), F.floor(F.col("rank") / ARITY).alias("node")).agg(F.sort_array(F.collect_list(F.struct("rank", "id", "digest", "altered_leaf"))).alias("asked"))
    both = at.join(asked, F.col("tree").eqNullSafe(F.col("of")) & (F.col("no") == F.col("node")))
    each = both.select("height", "path", "children", "about.*", F.posexplode("asked").alias("digit", "r"))
    return each.select(F.col("r.id").alias(order), F.col("r.digest").alias("leaf"), "subroot", "root", F.reverse(steps).alias("path"), F.col("r.altered_leaf").alias("altered_leaf"))


def proof_digest(path: Column) -> Column:
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))
