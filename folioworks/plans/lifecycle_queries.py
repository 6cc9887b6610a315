"""Retention, sessions, lockouts, audit and access."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folioworks.operators import lifecycle, lockouts
from folioworks.plans import surrogates
from folioworks.streaming.sessions import run_available
from folioworks.streaming.sign_ins import session_ends as ended_sessions
from folioworks.streaming.sign_ins import with_state_store
from folioworks.tables import shared_dir, table

def now():
    return F.lit(surrogates.NOW).cast("timestamp")


def with_due(spark, sf_dir):
    at, which = lifecycle.due(F.col("delete_after"), F.col("remediated_at"), F.col("reviewer"), F.col("created_at"))
    return surrogates.jobs(spark, sf_dir).select("job_id", at.alias("due_at"), which.alias("clock"), (F.col("job_id") % 5 == 0).alias("gone"))


def retention_due(spark, sf_dir):
    return with_due(spark, sf_dir).select("job_id", F.date_format("due_at", "yyyy-MM-dd HH:mm:ss").alias("due_at"), "clock")


def retention_expired(spark, sf_dir):
    rows = with_due(spark, sf_dir)
    return rows.select("job_id", lifecycle.expired(F.col("due_at"), now()).alias("expired"), lifecycle.days_left(F.col("due_at"), now()).alias("days_left"))


def sweep(spark, sf_dir):
    rows = with_due(spark, sf_dir).withColumn("deleted_at", F.when(F.col("gone"), now()))
    return lifecycle.swept(rows, now()).select("job_id", "clock")


def event_times(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def session_state(spark, sf_dir):
    """By user: first and last event of a day as a session; every thirteenth user's record is corrupt."""
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    days = event_times(spark, sf_dir).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    started = F.when(F.col("user_id") % 13 == 0, "corrupt").otherwise(text(F.col("a")))
    noon = F.col("day").cast("timestamp") + F.expr("INTERVAL 12 HOURS")
    return days.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), lifecycle.session_state(started, text(F.col("b")), noon).alias("state"))


def session_islands(spark, sf_dir):
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return lifecycle.session_islands(event_times(spark, sf_dir)).select("user_id", "session", "events", text("started"), text("ended"))


def lockout_fold(spark, sf_dir):
    """Events as sign-ins, a minute apart for each four hours, their times rounded to whole seconds (halves to even ones); errors and clicks fail."""
    e = event_times(spark, sf_dir)
    attempts = e.select(F.col("user_id").alias("account"), F.col("event_id").alias("seq"), F.floor(F.rint(F.col("ts").cast("double")) / 240).alias("at"), (~F.col("event_type").isin("error", "click")).alias("matched"))
    return lockouts.lockouts(attempts).groupBy("account", "outcome").agg(F.count("*").alias("attempts"), F.sum("seq").alias("seqs"))


def reset_state(spark, sf_dir):
    e = event_times(spark, sf_dir)
    issued = F.when(F.col("event_id") % 17 == 0, "corrupt").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    used = F.when(F.col("event_id") % 5 == 0, F.lit("x"))
    later = F.col("ts") + F.make_interval(mins=(F.col("user_id") % 60).cast("int"))
    return e.select("event_id", lifecycle.reset_state(issued, used, later).alias("state"))


ACTIONS = ("account.created", "account.disabled", "sign-in.succeeded", "sign-in.failed", "sign-in.locked", "sign-out", "session.expired", "reset.requested", "reset.completed", "mail.failed", "job.created", "job.opened", "job.remediated", "job.downloaded", "job.deleted", "finding.decided", "criterion.confirmed", "reviewer.named", "alt.drafted", "statement.downloaded")


def audit_history(spark, sf_dir):
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    action = F.get(F.array(*map(F.lit, ACTIONS)), (F.col("event_id") % len(ACTIONS)).cast("int"))
    at = F.when(F.col("event_id") % 29 == 0, "?").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    rows = event_times(spark, sf_dir).select(F.col("user_id").alias("account"), action.alias("action"), at.alias("at"))
    return lifecycle.history(rows).select("account", "events", "unreadable", "security", text("first_at"), text("last_at"))


def may_open(spark, sf_dir):
    """Each customer looks at the jobs of its own number, and of the next customer's."""
    jobs = surrogates.jobs(spark, sf_dir).select("job_id", "account", "visitor", F.coalesce("account", "visitor", F.lit(-1)).alias("holder"))
    viewer = F.explode(F.array(F.col("holder"), F.col("holder") + 1))
    seen = jobs.select("*", viewer.alias("viewer"))
    opens = lifecycle.may_open(F.col("account"), F.col("visitor"), F.when(F.col("viewer") % 2 == 0, F.col("viewer")), F.col("viewer"))
    return seen.groupBy("viewer").agg(F.count_if(opens).alias("opens"), F.count_if(~opens).alias("refused"))


def claim_jobs(spark, sf_dir):
    viewers = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey") + 1000000).alias("account"), F.col("c_custkey").alias("visitor"))
    return lifecycle.claimed(surrogates.jobs(spark, sf_dir), viewers)


def sign_ins(spark, sf_dir):
    """Events as sign-ins, their times rounded to milliseconds: a token for each user and day, opened by the first event; purchases sign out."""
    at = F.timestamp_millis(F.round(F.unix_micros("ts").cast("decimal(20, 0)") / 1000).cast("long"))
    e = event_times(spark, sf_dir).select(F.col("user_id").cast("string").alias("account"), F.date_format("ts", "yyyyMMdd").alias("day"), at.alias("at"), F.col("event_id").alias("seq"), "event_type")
    firsts = e.groupBy("account", "day").agg(F.min(F.struct("at", "seq")).alias("first"))
    e = e.join(firsts, ["account", "day"])
    event = F.when((F.col("at") == F.col("first.at")) & (F.col("seq") == F.col("first.seq")), "start").when(F.col("event_type") == "purchase", "end").otherwise("touch")
    return e.select("account", F.concat_ws("-", "account", "day").alias("token"), "at", "seq", event.alias("event"))


def session_ends(spark, sf_dir):
    """A stream over all sign-ins, with what has ended by the time the watermark reaches."""
    folder = f"{shared_dir(spark)}/sessions-{uuid.uuid4().hex}"
    sign_ins(spark, sf_dir).write.parquet(f"{folder}/in")
    with_state_store(spark)
    came = spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).parquet(f"{folder}/in")
    run_available(ended_sessions(came), f"{folder}/out", f"{folder}/state")
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return spark.read.parquet(f"{folder}/out").select("account", "token", text("started"), text("ended"), "reason")


QUERIES = {f.__name__: f for f in (session_ends, retention_due, retention_expired, sweep, session_state, session_islands, lockout_fold, reset_state, audit_history, may_open, claim_jobs)}

JOBS_SQL = f"""j AS (SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 11 = 0 THEN TIMESTAMP '1970-01-01' ELSE o_orderdate::TIMESTAMP + INTERVAL 72 HOURS END AS c, CASE WHEN o_orderstatus = 'P' THEN o_orderdate::TIMESTAMP + INTERVAL 4 DAYS END AS m, o_orderpriority LIKE '1%' AS held,
  CASE WHEN o_orderkey % 7 = 0 THEN o_orderdate::TIMESTAMP + INTERVAL 7 DAYS END AS d FROM orders),
u AS (SELECT job_id, CASE WHEN d IS NOT NULL THEN d WHEN m IS NOT NULL THEN m WHEN held THEN NULL ELSE c END AS due_at, CASE WHEN d IS NOT NULL THEN 'downloaded' WHEN m IS NOT NULL THEN 'uncollected' WHEN held THEN NULL ELSE 'untouched' END AS clock, TIMESTAMP '{surrogates.NOW}' AS now FROM j)"""
STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S')"
ACTIONS_SQL = "['" + "', '".join(ACTIONS) + "']"
HOLD_SQL = "h AS (SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS account, CASE WHEN o_orderkey % 3 = 1 THEN o_custkey END AS visitor FROM orders)"

ORACLE_SQL = {
    "session_ends": """WITH e AS (SELECT user_id::VARCHAR AS account, user_id || '-' || strftime(ts, '%Y%m%d') AS token, epoch_ms(ts) AS ms, event_id AS seq, event_type = 'purchase' AS out FROM events),
g AS (SELECT *, ms - lag(ms) OVER w >= 1800000 AS gap, first_value(ms) OVER w AS started, row_number() OVER w AS i FROM e WINDOW w AS (PARTITION BY token ORDER BY ms, seq)),
a AS (SELECT *, coalesce(bool_or(gap OR ms >= started + 28800000) OVER (PARTITION BY token ORDER BY ms, seq), false) AS dead FROM g),
l AS (SELECT *, coalesce(bool_or(out AND i > 1 AND NOT dead) OVER (PARTITION BY token ORDER BY ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS gone FROM a WHERE NOT dead),
s AS (SELECT account, token, started, max(ms) AS seen, min(ms) FILTER (out AND i > 1) AS left_ FROM l WHERE NOT gone GROUP BY 1, 2, 3),
d AS (SELECT *, least(seen + 1800000, started + 28800000) AS due FROM s)
SELECT account, token, strftime(make_timestamp(started * 1000), '%Y-%m-%d %H:%M:%S') AS started, strftime(make_timestamp(coalesce(left_, due) * 1000), '%Y-%m-%d %H:%M:%S') AS ended,
CASE WHEN left_ IS NOT NULL THEN 'signed-out' WHEN started + 28800000 <= seen + 1800000 THEN 'expired' ELSE 'idle' END AS reason FROM d WHERE left_ IS NOT NULL OR due <= (SELECT max(ms) FROM e) - 3600000""",
    "lockout_fold": """WITH RECURSIVE t AS (SELECT user_id AS account, event_id AS seq, epoch(ts)::BIGINT // 240 AS sec, event_type NOT IN ('error', 'click') AS matched, row_number() OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT // 240, event_id) AS i FROM events),
f AS (SELECT account, 0::BIGINT AS i, 0 AS n, NULL::BIGINT AS last, NULL::VARCHAR AS outcome, NULL::BIGINT AS seq FROM t GROUP BY 1
UNION ALL SELECT account, i, CASE WHEN outcome = 'locked' THEN n WHEN outcome = 'ok' THEN 0 WHEN recent THEN n + 1 ELSE 1 END, CASE WHEN outcome = 'locked' THEN last WHEN outcome = 'failed' THEN sec END, outcome, seq
FROM (SELECT t.account, t.i, n, last, sec, coalesce(sec - last < 900, false) AS recent, CASE WHEN n >= 5 AND coalesce(sec - last < 900, false) THEN 'locked' WHEN matched THEN 'ok' ELSE 'failed' END AS outcome, t.seq FROM f JOIN t ON t.account = f.account AND t.i = f.i + 1))
SELECT account, outcome, count(*) AS attempts, sum(seq)::BIGINT AS seqs FROM f WHERE i > 0 GROUP BY 1, 2""",
    "retention_due": f"WITH {JOBS_SQL} SELECT job_id, {STAMP.format('due_at')} AS due_at, clock FROM u",
    "retention_expired": f"WITH {JOBS_SQL} SELECT job_id, coalesce(now >= due_at, false) AS expired, CASE WHEN due_at IS NULL THEN NULL WHEN now >= due_at THEN 0 ELSE ceil(epoch(due_at - now) / 86400)::BIGINT END AS days_left FROM u",
    "sweep": f"WITH {JOBS_SQL} SELECT job_id, clock FROM u WHERE job_id % 5 <> 0 AND now >= due_at",
    "session_state": """WITH d AS (SELECT user_id, ts::DATE AS day, min(ts) AS a, max(ts) AS b, ts::DATE::TIMESTAMP + INTERVAL 12 HOURS AS now FROM events GROUP BY ALL)
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, CASE WHEN user_id % 13 = 0 THEN 'expired' WHEN now >= date_trunc('second', a) + INTERVAL 8 HOURS THEN 'expired' WHEN now >= date_trunc('second', b) + INTERVAL 30 MINUTES THEN 'idle' ELSE 'active' END AS state FROM d""",
    "session_islands": f"""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g)
SELECT user_id, session, count(*) AS events, {STAMP.format('min(ts)')} AS started, {STAMP.format('max(ts)')} AS ended FROM s GROUP BY 1, 2""",
    "reset_state": "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'used' WHEN event_id % 17 = 0 OR ts + to_minutes(user_id % 60) >= date_trunc('second', ts) + INTERVAL 30 MINUTES THEN 'expired' ELSE 'good' END AS state FROM events",
    "audit_history": f"""WITH a AS (SELECT user_id AS account, {ACTIONS_SQL}[(event_id % 20)::INT + 1] AS action, CASE WHEN event_id % 29 <> 0 THEN ts END AS t FROM events)
SELECT account, count(t) AS events, count(*) - count(t) AS unreadable, count(*) FILTER (action LIKE 'account%' OR action LIKE 'sign-in%' OR action LIKE 'reset%' OR action = 'session.expired' OR action = 'mail.failed') AS security, {STAMP.format('min(t)')} AS first_at, {STAMP.format('max(t)')} AS last_at FROM a GROUP BY 1""",
    "may_open": f"""WITH {HOLD_SQL}, v AS (SELECT *, unnest([coalesce(account, visitor, -1), coalesce(account, visitor, -1) + 1]) AS viewer FROM h),
o AS (SELECT viewer, CASE WHEN account IS NOT NULL THEN viewer % 2 = 0 AND account = viewer WHEN visitor IS NOT NULL THEN visitor = viewer ELSE false END AS opens FROM v)
SELECT viewer, count(*) FILTER (opens) AS opens, count(*) FILTER (NOT opens) AS refused FROM o GROUP BY 1""",
    "claim_jobs": f"""WITH {HOLD_SQL} SELECT job_id, CASE WHEN account IS NOT NULL THEN account WHEN c_custkey % 2 = 0 THEN c_custkey + 1000000 END AS account, CASE WHEN account IS NULL AND c_custkey % 2 = 0 THEN NULL ELSE visitor END AS visitor, account IS NULL AND c_custkey IS NOT NULL AND c_custkey % 2 = 0 AS claimed FROM h LEFT JOIN customer ON visitor = c_custkey""",
}
