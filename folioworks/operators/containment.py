"""Containment in nested sets: which elements hold which, as an equi-join.

An element holds the numbers from the one after its own to its last descendant's. That range is cut into aligned blocks of a power of
two, at most two for each power; a number lies in one aligned block of each power. Joining blocks by (tree, power, number of
the block) meets every pair of holder and held once, and no other pair; a hot tree is split by its blocks. A held
element is only sent to the powers that the holders of its tree use.

Elements have the columns `by`, pre and last. Defined cases: an element doesn't hold itself; leaves hold nothing; rows that repeat an
element repeat its pairs; trees that only one side has, and empty sides, give no pairs; null keys meet nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def aligned(low: Column, high: Column) -> Column:
    """Aligned blocks that make up low..high: array<struct<power,block>>."""
    start = F.struct(low.cast("long").alias("at"), F.array().cast("array<struct<power:int,block:bigint>>").alias("out"))

    def step(acc: Column, _: Column) -> Column:
        at, room = acc["at"], high - acc["at"] + 1
        # The largest power that divides `at` and fits what is left.
        even = F.when(at == 0, 62).otherwise(F.log2(at.bitwiseAND(-at).cast("double")).cast("int"))
        fits = F.floor(F.log2(room.cast("double"))).cast("int")
        power = F.least(even, fits)
        block = F.struct(power.alias("power"), F.floor(at / F.pow(F.lit(2.0), power)).cast("long").alias("block"))
        return F.when(room <= 0, acc).otherwise(F.struct((at + F.pow(F.lit(2.0), power).cast("long")).alias("at"), F.concat(acc["out"], F.array(block)).alias("out")))

    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), 2 * F.ceil(F.log2((high - low + 2).cast("double"))).cast("int")))
    return F.when(low <= high, F.aggregate(steps, start, step, lambda acc: acc["out"])).otherwise(F.array().cast("array<struct<power:int,block:bigint>>"))


def pairs(holders: DataFrame, held: DataFrame, by: list[str]) -> DataFrame:
    """Each pair of an element of `holders` and one of `held` below it: `by`, then their other columns as structs `holder` and `held`."""
    pack = lambda df, name: df.select(*by, F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in by]).alias(name))
    outer = pack(holders.where("pre < last"), "holder")
    outer = outer.select(*by, "holder", F.explode(aligned(F.col("holder.pre") + 1, F.col("holder.last"))).alias("b")).select(*by, "holder", "b.*")
    powers = outer.groupBy(*by).agg(F.collect_set("power").alias("powers"))
    inner = pack(held, "held").join(powers, by).select(*by, "held", F.explode("powers").alias("power"))
    inner = inner.withColumn("block", F.floor(F.col("held.pre") / F.pow(F.lit(2.0), F.col("power"))).cast("long"))
    return outer.join(inner, [*by, "power", "block"]).select(*by, "holder", "held")


def first_in(holders: DataFrame, held: DataFrame, by: list[str]) -> DataFrame:
    """`by`, pre of the holder, held: the first one below each holder that has any."""
    both = pairs(holders, held, by)
    return both.groupBy(*by, F.col("holder.pre").alias("pre")).agg(F.min_by("held", "held.pre").alias("held"))


def innermost(held: DataFrame, holders: DataFrame, by: list[str]) -> DataFrame:
    """`by`, pre of the held element, holder: the last one to start of those that hold it."""
    both = pairs(holders, held, by)
    return both.groupBy(*by, F.col("held.pre").alias("pre")).agg(F.max_by("holder", "holder.pre").alias("holder"))
