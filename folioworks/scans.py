"""Numbers and states along ordered rows, where one group may hold most of a table.

A window over a group puts that group into one task. Here rows are dealt by ranges of (group, order) instead, counted by
task, and only the counts meet in windows: at most one for each group and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioworks.tables import stored, unused_name

#: Segments that are folded together in one step of `carried`.
FAN = 64


def numbered(rows: DataFrame, group: list[str], order: list[str], counted: Column | None = None) -> DataFrame:
    """Adds `rank` (from 0) of each row within its `group` by `order`, nulls first, and `total`, the group's rows.

    With `counted`, only rows for which it holds count: `rank` is then the number of such rows before. Rows equal in all of
    `group` and `order` get neighbouring ranks in any order. The rows are written once, in order, so that a task run again
    numbers them alike. `rows` is read twice: for the bounds of the ranges, and for the rows.
    """
    at, task, counts, first, before = (unused_name(n, [*rows.columns, "rank", "total"]) for n in ("at", "task", "counts", "first", "before"))
    weight = F.lit(1) if counted is None else F.when(counted, 1).otherwise(0)
    keys = [*group, *order]
    dealt = stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(at, F.monotonically_increasing_id()).withColumn(counts, weight), "ordered")
    dealt = dealt.withColumn(task, F.shiftright(at, 33))
    # Names of their own, so that the two sides of the join differ.
    mine = {c: unused_name(f"of_{c}", dealt.columns) for c in [*group, task]}
    parts = dealt.select(*[F.col(c).alias(n) for c, n in mine.items()], at, F.col(counts).alias("n")).groupBy(*mine.values()).agg(F.sum("n").alias("n"), F.min(at).alias(first))
    groups = [mine[c] for c in group]
    earlier = Window.partitionBy(*groups).orderBy(mine[task]).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*mine.values(), first, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before), F.sum("n").over(Window.partitionBy(*groups)).alias("total"))
    equal = F.lit(True)
    for c, n in mine.items():
        equal = equal & F.col(c).eqNullSafe(F.col(n))
    joined = dealt.join(parts, equal)
    if counted is None:
        within = F.col(at) - F.col(first)
    else:
        within = F.coalesce(F.sum(counts).over(Window.partitionBy(*group, task).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return joined.select(*rows.columns, (within + F.col(before)).cast("long").alias("rank"), F.col("total").cast("long").alias("total"))


def carried(segments: DataFrame, key: str, start: Column) -> DataFrame:
    """key, no, entering: the state in which each segment is entered.

    `segments` has key, no (from 0, gapless) and map, an array of the state (from 0) in which a segment is left by the state
    in which it is entered. The first one of a key is entered in `start`. FAN segments are composed to one, until a key
    has one left; then states go down again, so that no task holds more than FAN maps of a key.
    """
    most = segments.agg(F.max("no")).head()[0]
    if not most:
        return segments.select(key, "no", start.cast("int").alias("entering"))
    listed = segments.groupBy(key, F.floor(F.col("no") / FAN).alias("up")).agg(F.sort_array(F.collect_list(F.struct("no", "map"))).alias("parts"))
    whole = F.aggregate("parts", F.sequence(F.lit(0), F.size(F.get("parts", F.lit(0))["map"]) - 1), lambda acc, p: F.transform(acc, lambda x: F.get(p["map"], x)))
    listed = stored(listed.select(key, F.col("up").alias("no"), "parts", whole.alias("map")), "segments")
    above = carried(listed.select(key, "no", "map"), key, start)
    met = listed.join(above, [key, "no"]).select(key, "parts", "entering")
    states = F.aggregate("parts", F.array("entering"), lambda acc, p: F.concat(acc, F.array(F.get(p["map"], F.element_at(acc, -1)))))
    spread = met.select(key, F.explode(F.arrays_zip(F.col("parts").alias("p"), F.slice(states, 1, F.size("parts")).alias("s"))).alias("z"))
    return spread.select(key, F.col("z.p.no").alias("no"), F.col("z.s").alias("entering"))
