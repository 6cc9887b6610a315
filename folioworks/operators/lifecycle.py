"""Retention, sessions, lockouts and resets. Times are timestamps, or strings where a corrupt one has a meaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Days after a download, hours until collection, idle minutes, session hours, failures, lock minutes, reset minutes.
KEEP_DAYS, COLLECT_HOURS, IDLE_MINUTES, SESSION_HOURS, LOCK_AFTER, LOCK_MINUTES, RESET_MINUTES = 7, 72, 30, 8, 5, 15, 30
EPOCH = "1970-01-01 00:00:00"


def parsed(text: Column) -> Column:
    return F.try_to_timestamp(text)


def hours_after(text: Column, hours: int) -> Column:
    """A corrupt time counts as long past."""
    return F.coalesce(parsed(text) + F.expr(f"INTERVAL {hours} HOURS"), F.lit(EPOCH).cast("timestamp"))


def due(deleted: Column, remediated: Column, reviewer: Column, created: Column) -> tuple[Column, Column]:
    """When a job's files go and which clock says so; null while a reviewer works on them."""
    at = (
        F.when(deleted.isNotNull(), F.coalesce(parsed(deleted), F.lit(EPOCH).cast("timestamp")))
        .when(remediated.isNotNull(), hours_after(remediated, COLLECT_HOURS))
        .when(reviewer.isNotNull(), None)
        .when(created.isNotNull(), hours_after(created, COLLECT_HOURS))
    )
    which = F.when(deleted.isNotNull(), "downloaded").when(remediated.isNotNull(), "uncollected").when(reviewer.isNotNull(), None).when(created.isNotNull(), "untouched")
    return at, which


def expired(at: Column, now: Column) -> Column:
    return F.coalesce(now >= at, F.lit(False))


def days_left(at: Column, now: Column) -> Column:
    seconds = at.cast("long") - now.cast("long")
    return F.when(at.isNull(), None).when(now >= at, 0).otherwise(F.ceil(seconds / 86400)).cast("long")


def session_state(started: Column, seen: Column, now: Column) -> Column:
    """A corrupt time, or eight hours, ends a session; half an hour unseen makes it idle."""
    s, l = parsed(started), parsed(seen)
    return (
        F.when(s.isNull() | l.isNull(), "expired")
        .when(now >= s + F.expr(f"INTERVAL {SESSION_HOURS} HOURS"), "expired")
        .when(now >= l + F.expr(f"INTERVAL {IDLE_MINUTES} MINUTES"), "idle")
        .otherwise("active")
    )


def reset_state(issued: Column, used: Column, now: Column) -> Column:
    i = parsed(issued)
    return F.when(used.isNotNull(), "used").when(i.isNull() | (now >= i + F.expr(f"INTERVAL {RESET_MINUTES} MINUTES")), "expired").otherwise("good")


def session_islands(events: DataFrame) -> DataFrame:
    """By user, runs of events less than half an hour apart: number, events, start, end."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts") - F.lag("ts").over(order)
    new = F.when(F.coalesce(gap < F.expr(f"INTERVAL {IDLE_MINUTES} MINUTES"), F.lit(False)), 0).otherwise(1)
    numbered = events.withColumn("new", new).withColumn("session", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return numbered.groupBy("user_id", "session").agg(F.count("*").alias("events"), F.min("ts").alias("started"), F.max("ts").alias("ended"))


def swept(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs whose files go now: expired and not gone yet. `jobs` has due_at and deleted_at."""
    return jobs.where(F.col("deleted_at").isNull() & expired(F.col("due_at"), now)).withColumn("deleted_at", now)


def history(events: DataFrame) -> DataFrame:
    """By account: readable events, unreadable ones (no time), security events, first and last."""
    at = parsed(F.col("at"))
    security = F.col("action").rlike("^(account|sign-in|reset)") | F.col("action").isin("session.expired", "mail.failed")
    return events.groupBy("account").agg(
        F.count_if(at.isNotNull()).alias("events"), F.count_if(at.isNull()).alias("unreadable"), F.count_if(security).alias("security"), F.min(at).alias("first_at"), F.max(at).alias("last_at")
    )


def may_open(job_account: Column, job_visitor: Column, viewer_account: Column, viewer_visitor: Column) -> Column:
    """An account's job opens for the account; a browser's job for the browser, signed in or not."""
    return F.when(job_account.isNotNull(), F.coalesce(job_account == viewer_account, F.lit(False))).when(job_visitor.isNotNull(), F.coalesce(job_visitor == viewer_visitor, F.lit(False))).otherwise(False)


def claimed(jobs: DataFrame, viewers: DataFrame) -> DataFrame:
    """Jobs that a browser holds go to the account signed in there. `viewers`: account, visitor; one account for a visitor."""
    one = viewers.where("account is not null and visitor is not null").groupBy("visitor").agg(F.min("account").alias("claimer"))
    out = jobs.join(one, "visitor", "left")
    claims = F.col("account").isNull() & F.col("claimer").isNotNull()
    return out.select("job_id", F.coalesce("account", "claimer").alias("account"), F.when(claims, None).otherwise(F.col("visitor")).alias("visitor"), claims.alias("claimed"))
