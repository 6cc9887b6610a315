"""Accounts as a table keyed by the digest of an address: created if absent, with one winner for an address; changed and disabled.

Requests are judged in the order of the checks: address, passphrase, then whether the address is taken. Of several good requests for one
address in a batch the first by (at, seq) wins, whichever task sees it: that is an aggregate by digest, then a join with it. The
result doesn't hang on how the batch is split: requests that lose are `taken`, as they would be one by one.

Defined cases: rows that repeat a request (seq included) win together, as one; addresses that differ in case or outer space are one;
null addresses and passphrases are missing ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks.functions.text import email_problem, normalised_email, password_problem


def address_key(email: Column) -> Column:
    return F.sha2(normalised_email(email), 256)


def judged(requests: DataFrame, accounts: DataFrame) -> DataFrame:
    """Requests (seq, at, email, password) with `outcome`: bad-email, bad-password, taken or created; and `reason` of a bad one. accounts: key."""
    email = email_problem(F.col("email"))
    secret = password_problem(F.col("password"), F.col("email"))
    rows = requests.withColumn("key", address_key(F.col("email"))).withColumn("reason", F.coalesce(email, secret)).withColumn("bad", F.when(email.isNotNull(), "bad-email").when(secret.isNotNull(), "bad-password"))
    good = rows.where("bad is null")
    free = good.groupBy("key").agg(F.min(F.struct("at", "seq")).alias("winner")).join(accounts.select("key").distinct(), "key", "left_anti")
    met = rows.join(free, "key", "left")
    won = F.coalesce(F.struct("at", "seq") == F.col("winner"), F.lit(False))
    return met.withColumn("outcome", F.when(F.col("bad").isNotNull(), F.col("bad")).when(won, "created").otherwise("taken")).select(*requests.columns, "key", "outcome", "reason")


def created(accounts: DataFrame, requests: DataFrame) -> DataFrame:
    """Accounts (key, email, created_at, changed_at, disabled_at) with those that requests create."""
    new = judged(requests, accounts).where("outcome = 'created'").select("key", normalised_email(F.col("email")).alias("email"), F.col("at").alias("created_at")).distinct()
    none = F.lit(None).cast(new.schema["created_at"].dataType)
    return accounts.select("key", "email", "created_at", "changed_at", "disabled_at").unionByName(new.withColumns({"changed_at": none, "disabled_at": none}))


def updated(accounts: DataFrame, events: DataFrame) -> DataFrame:
    """Accounts after events (key, at, event: change or disable). The first disabling stands; a change counts if it comes before it."""
    ends = events.where("event = 'disable' and at is not null").groupBy("key").agg(F.min("at").alias("ended"))
    rows = accounts.join(ends, "key", "left").withColumn("disabled_at", F.least("disabled_at", "ended"))
    changes = events.where("event = 'change'").select("key", "at").join(rows.select("key", "disabled_at"), "key").where("disabled_at is null or at < disabled_at").groupBy("key").agg(F.max("at").alias("changed"))
    return rows.join(changes, "key", "left").select("key", "email", "created_at", F.greatest("changed_at", "changed").alias("changed_at"), "disabled_at")
