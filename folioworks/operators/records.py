"""Records of jobs as JSON: read with what can't be read counted, brought up to date, delivered once.

A record's shape has changed: the first ones have findings without a kind, later ones PDFs without a tier. `read` tells which
a record is; only stale ones are detected again (`refreshed`), by a semi join on the few that need it. Delivery acts on the first
download alone: it starts the clock and takes the customer's words out of the nested fields, and doing it again changes nothing.

Defined cases: a record that is no JSON object is a row with its text and no fields; a null record is unreadable too; unknown fields are
dropped; of two records of one key all stay; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks.functions.text import scrub_quotes
from folioworks.operators.lifecycle import KEEP_DAYS

REMOVED = "[removed]"
FINDING = "kind string, criterion string, location string, description string, severity string, remediated boolean, anchor string, decision struct<action:string,value:string,note:string,by:string,at:string>, proposal struct<text:string,at:string>"
JOB = f"id string, format string, tier string, created_at string, findings array<struct<{', '.join(f.replace(' ', ':', 1) for f in FINDING.split(', '))}>>, applied array<struct<kind:string,location:string,description:string>>, delete_after string, scrubbed_at string, unread string"
CURRENT, UNREADABLE = 3, 0


def job_keys(keys: DataFrame) -> DataFrame:
    """key: the jobs of a store, as the first part of its keys where that is an identifier."""
    first = F.get(F.split("key", "/"), F.lit(0))
    return keys.select(first.alias("job")).where(F.col("job").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")).distinct()


def read(records: DataFrame) -> DataFrame:
    """key, version, the fields of a job, unread (the text, of a record that can't be read). records: key, json.

    Version 1 lacks a finding's kind, version 2 a PDF's tier, version 3 is current, version 0 can't be read.
    """
    parsed = records.select("key", "json", F.from_json("json", JOB, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "unread"}).alias("job"))
    bad = F.col("json").isNull() | F.col("job").isNull() | F.col("job.unread").isNotNull() | ~F.coalesce(F.ltrim("json").startswith("{"), F.lit(False))
    untyped = F.exists(F.coalesce("job.findings", F.array()), lambda f: f["kind"].isNull())
    version = F.when(bad, UNREADABLE).when(untyped, 1).when((F.col("job.format") == "pdf") & F.col("job.tier").isNull(), 2).otherwise(CURRENT)
    fields = [f.strip().split(" ")[0] for f in ("id", "format", "tier", "created_at", "findings", "applied", "delete_after", "scrubbed_at")]
    of = lambda f: F.when(~bad, F.col(f"job.{f}")).alias(f)
    return parsed.select("key", version.alias("version"), *map(of, fields), F.when(bad, F.coalesce("json", F.lit(""))).alias("unread"))


def written(jobs: DataFrame) -> DataFrame:
    """key, json: the records of jobs; those that couldn't be read as they were."""
    fields = [c for c in jobs.columns if c not in ("key", "version", "unread")]
    return jobs.select("key", F.coalesce("unread", F.to_json(F.struct(*fields))).alias("json"))


def stale(jobs: DataFrame) -> DataFrame:
    return jobs.where(f"version not in ({CURRENT}, {UNREADABLE})")


def refreshed(jobs: DataFrame, detected: DataFrame) -> DataFrame:
    """Jobs with those that are stale detected again. detected: key, findings, tier, of any jobs; only stale ones are met.

    A stale job that nothing was detected for (its document is gone) stays as it is. Decisions on findings that are found
    again, by kind and anchor, are kept.
    """
    new = detected.join(stale(jobs).select("key").distinct(), "key", "left_semi").select("key", F.col("findings").alias("new"), F.col("tier").alias("new_tier"))
    old = F.filter(F.coalesce("findings", F.array()), lambda f: f["decision"].isNotNull())
    kept = F.transform("new", lambda f: f.withField("decision", F.coalesce(f["decision"], F.get(F.filter(old, lambda o: (o["kind"] == f["kind"]) & o["anchor"].eqNullSafe(f["anchor"])), F.lit(0))["decision"])))
    met = jobs.join(new, "key", "left")
    due = F.col("new").isNotNull() & ~F.col("version").isin(CURRENT, UNREADABLE)
    return met.select(
        *[
            F.when(due, kept).otherwise(F.col("findings")).alias(c) if c == "findings" else F.when(due, F.coalesce("new_tier", "tier")).otherwise(F.col("tier")).alias(c) if c == "tier" else F.when(due, CURRENT).otherwise(F.col("version")).alias(c) if c == "version" else F.col(c)
            for c in jobs.columns
        ]
    )


def scrubbed_finding(f: Column) -> Column:
    """Quotations go from location, description and note; a proposal's text and a decision's value go whole."""
    out = f.withField("location", scrub_quotes(f["location"])).withField("description", scrub_quotes(f["description"]))
    decision = f["decision"].withField("value", F.when(f["decision"]["value"].isNotNull(), REMOVED)).withField("note", scrub_quotes(f["decision"]["note"]))
    return out.withField("proposal", F.when(f["proposal"].isNotNull(), f["proposal"].withField("text", F.lit(REMOVED)))).withField("decision", F.when(f["decision"].isNotNull(), decision))


def delivered(jobs: DataFrame, downloads: DataFrame) -> DataFrame:
    """Jobs after downloads (key, at): the first one starts the clock of a job that has none, and scrubs its record.

    `at` is a time; a download without one, or of a job that isn't there, does nothing.
    """
    first = downloads.where("at is not null").groupBy("key").agg(F.min("at").alias("at"))
    met = jobs.join(first, "key", "left")
    due = F.col("at").isNotNull() & F.col("delete_after").isNull()
    text = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    changed = {
        "findings": F.transform("findings", scrubbed_finding),
        "applied": F.transform("applied", lambda a: a.withField("location", scrub_quotes(a["location"])).withField("description", scrub_quotes(a["description"]))),
        "delete_after": text(F.col("at") + F.expr(f"INTERVAL {KEEP_DAYS} DAYS")),
        "scrubbed_at": text(F.col("at")),
    }
    return met.select(*[F.when(due, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in jobs.columns])
