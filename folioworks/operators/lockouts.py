"""Sign-in attempts folded to outcomes: after LOCK_AFTER failures an account is locked for a while, and attempts meanwhile don't count.

Whether an attempt counts hangs on those before it, but only through one thing: from which attempt on the account was as new
(nothing failed of late). From a fresh attempt, the next fresh one follows from at most LOCK_AFTER attempts after it and from the first
attempt that comes once a lock has run out. So the fold is a walk along these hops. Attempts are numbered by ranges and cut
into blocks; within a block, hops are doubled until they leave it, for all attempts at once; over the blocks of an account, the
hops from block to block are doubled by joins on those few attempts at which a block can be entered. An account with a third
of all attempts is as many tasks as it has blocks; only accounts of more than one block take part in the joins.

Attempts come in the order of (at, seq); `at` is in whole seconds. Defined cases: rows of equal at and seq stand in any order; an
attempt whose `matched` is null failed; a null account is one of its own; rows without `at` come first and are long past.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioworks.operators.lifecycle import LOCK_AFTER, LOCK_MINUTES
from folioworks.scans import numbered
from folioworks.tables import stored

BLOCK = 1024
LOCK = LOCK_MINUTES * 60


def with_release(attempts: DataFrame) -> DataFrame:
    """Adds `until`: the rank of the first attempt that comes when a lock set by this one has run out (the account's total if none does)."""
    ranked = stored(numbered(attempts, ["account"], ["at", "seq"]), "attempts")
    ends = ranked.select("account", (F.col("at") + LOCK).alias("at"), F.lit(0).alias("kind"), "rank")
    starts = ranked.select("account", "at", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("rank"))
    # The end of a lock comes before an attempt at the same second; only attempts count.
    met = numbered(ends.union(starts).withColumnRenamed("rank", "of"), ["account"], ["at", "kind"], F.col("kind") == 1)
    until = met.where("kind = 0").select("account", F.col("of").alias("rank"), F.col("rank").alias("until"))
    return ranked.join(until, ["account", "rank"])


def hop(a: Column, i: Column) -> Column:
    """From a fresh attempt, the i-th of `a`, the rank of the next fresh one."""
    at = lambda k: F.get(a, i + k)
    first = at(0)["rank"]
    out = at(LOCK_AFTER - 1)["until"]
    for k in reversed(range(LOCK_AFTER)):
        out = F.when(at(k)["matched"], first + k + 1).otherwise(out)
        if k:
            out = F.when(at(k).isNull() | (at(k)["at"] - at(k - 1)["at"] >= LOCK), first + k).otherwise(out)
    return out


def blocks_of(attempts: DataFrame) -> DataFrame:
    """account, block, start, end, total, a (attempts in order, and the next few), hops (by attempt: the next fresh one), leaves (by attempt: where its hops leave the block, and the last one in it)."""
    no = F.floor(F.col("rank") / BLOCK)
    ahead = (F.col("rank") % BLOCK < LOCK_AFTER - 1) & (F.col("rank") >= BLOCK)
    shown = attempts.select("account", "total", F.explode(F.when(ahead, F.array(no, no - 1)).otherwise(F.array(no))).alias("block"), F.struct("rank", "at", "matched", "until", "seq").alias("t"))
    rows = shown.groupBy("account", "total", "block").agg(F.sort_array(F.collect_list("t")).alias("a"))
    rows = rows.select("account", "total", "block", "a", (F.col("block") * BLOCK).alias("start"), F.least(F.col("total"), (F.col("block") + 1) * BLOCK).alias("end"))
    places = F.sequence(F.lit(0), (F.col("end") - F.col("start") - 1).cast("int"))
    rows = rows.withColumn("hops", F.transform(places, lambda i: hop(F.col("a"), i)))
    begun = F.transform("hops", lambda x, i: F.struct(x.alias("out"), (F.col("start") + i).alias("last")))
    doubled = lambda acc, _: F.transform(acc, lambda s: F.when(s["out"] < F.col("end"), F.get(acc, (s["out"] - F.col("start")).cast("int"))).otherwise(s))
    return rows.withColumn("leaves", F.aggregate(F.sequence(F.lit(1), F.lit(BLOCK.bit_length())), begun, doubled))


def entered(blocks: DataFrame) -> DataFrame:
    """account, entry, out, last: the attempts at which the blocks of long accounts are entered, from the account's first one on."""
    long_ = blocks.where(F.col("total") > BLOCK)
    outs = long_.select("account", F.explode("leaves").alias("s")).select("account", F.col("s.out").alias("entry"))
    points = outs.union(long_.where("block = 0").select("account", F.lit(0).cast("long"))).distinct().withColumn("block", F.floor(F.col("entry") / BLOCK))
    leave = F.get("leaves", (F.col("entry") - F.col("start")).cast("int"))
    points = stored(points.join(long_, ["account", "block"]).where(F.col("entry") < F.col("total")).select("account", "entry", leave["out"].alias("out"), leave["last"].alias("last")), "entries")
    most = long_.agg(F.max("block")).head()[0]
    reached, hops = points.where("entry = 0").select("account", "entry"), points.select("account", "entry", "out")
    for _ in range(math.ceil(math.log2(most + 1)) if most else 0):
        reached = stored(reached.union(reached.join(hops, ["account", "entry"]).select("account", "out")), "reached")
        hops = stored(hops.join(hops.select("account", F.col("entry").alias("out"), F.col("out").alias("far")), ["account", "out"]).select("account", "entry", F.col("far").alias("out")), "hops")
    return points.join(reached, ["account", "entry"])


def lockouts(attempts: DataFrame) -> DataFrame:
    """Adds `outcome` (ok, failed, locked) to sign-in attempts (account, seq, at in seconds, matched)."""
    known = attempts.select(F.coalesce(F.concat(F.lit("="), F.col("account").cast("string")), F.lit("")).alias("account"), "seq", F.coalesce(F.col("at").cast("long"), F.lit(-(1 << 50))).alias("at"), F.coalesce("matched", F.lit(False)).alias("matched"))
    blocks = stored(blocks_of(with_release(known)), "blocks")
    at = stored(entered(blocks), "entered")
    first, after = F.floor(F.col("entry") / BLOCK), F.floor(F.least(F.col("out"), F.col("total") - 1) / BLOCK)
    totals = blocks.where("block = 0").select("account", "total")
    later = at.join(totals, "account").where(after > first).select("account", F.explode(F.sequence(first + 1, after)).alias("block"), F.col("last").alias("before"))
    entries = at.select("account", first.alias("block"), "entry")
    rows = blocks.join(later, ["account", "block"], "left").join(entries, ["account", "block"], "left").withColumn("entry", F.when(F.col("block") == 0, 0).otherwise(F.col("entry")))
    following = lambda acc: F.get("hops", (F.element_at(acc, -1) - F.col("start")).cast("int"))
    walk = lambda acc, _: F.when(following(acc) < F.col("end"), F.concat(acc, F.array(following(acc)))).otherwise(acc)
    fresh = F.when(F.col("entry").isNull(), F.array().cast("array<bigint>")).otherwise(F.aggregate("hops", F.array("entry"), walk))
    own = F.filter("a", lambda t: t["rank"] < F.col("end"))
    each = rows.withColumn("fresh", fresh).select("account", "block", "before", F.explode(F.transform(own, lambda t: t.withField("fresh", F.array_contains("fresh", t["rank"])))).alias("t"))
    since = F.coalesce(F.last(F.when(F.col("t.fresh"), F.col("t.rank")), ignorenulls=True).over(Window.partitionBy("account", "block").orderBy("t.rank")), F.col("before"))
    outcome = F.when(F.col("t.rank") - since >= LOCK_AFTER, "locked").when(F.col("t.matched"), "ok").otherwise("failed")
    kind = attempts.schema["account"].dataType
    at_ = F.nullif(F.col("t.at"), F.lit(-(1 << 50)))
    return each.select(F.when(F.col("account") != "", F.substring("account", 2, 1 << 30)).cast(kind).alias("account"), F.col("t.seq").alias("seq"), at_.alias("at"), F.col("t.matched").alias("matched"), outcome.alias("outcome"))
