"""Records of three versions and corrupt ones, deliveries, figure sources and accounts, derived from orders, their lines and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioworks.operators import accounts, figures, records
from folioworks.plans import catalog
from folioworks.tables import stored, table

TARGETS = (
    ("media/image1.png", None, "word/media/image1.png", "image/png", None), ("../media/./Photo.JPG", None, "media/Photo.JPG", "image/jpeg", None), ("/word//media/a.jpeg", None, "word/media/a.jpeg", "image/jpeg", None), ("https://example.org/x.png", None, None, None, "external"),
    ("media/b.png", "External", None, None, "external"), ("media/c.emf", None, None, None, "type"), ("a/../../../b/d.gif", "Internal", "b/d.gif", "image/gif", None), ("", None, None, None, "target"), (None, None, None, None, "target"), ("noending", None, None, None, "type"),
)


def job_records(spark, sf_dir):
    """Orders as records by o_orderkey modulo 5: broken JSON, version 1, version 2, a current one, no record at all; findings are their lines."""
    k = F.col("l_orderkey")
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    line = F.col("l_linenumber").cast("string")
    kinds = F.get(F.array(*[F.lit(n) for n, _ in catalog.KINDS]), (F.col("l_partkey") % len(catalog.KINDS)).cast("int"))
    found = F.struct(
        F.when((k % 5 != 1) | (F.col("l_linenumber") > 1), kinds).alias("kind"), F.lit("1.1.1").alias("criterion"), text("page ", line, " (“quoted ", line, "”) of it").alias("location"), F.lit("It says “this” and “that”.").alias("description"),
        F.lit("partial").alias("severity"), F.lit(False).alias("remediated"), text("docPr:", line).alias("anchor"),
        F.when(F.col("l_suppkey") % 3 == 0, F.struct(F.lit("apply").alias("action"), text("value ", line).alias("value"), F.when(F.col("l_suppkey") % 2 == 0, "note “x” y").alias("note"), F.lit("r").alias("by"), F.lit("t").alias("at"))).alias("decision"),
        F.when(F.col("l_suppkey") % 4 == 0, F.struct(text("draft ", line).alias("text"), F.lit("t").alias("at"))).alias("proposal"),
    )
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", found.alias("f")))), lambda s: s["f"]).alias("findings"))
    o = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    key = F.col("o_orderkey")
    pdf = key % 2 == 0
    job = F.struct(
        key.cast("string").alias("id"), F.when(pdf, "pdf").otherwise("docx").alias("format"), F.when(key % 5 != 2, "tagged").alias("tier"), F.coalesce("findings", F.array()).alias("findings"),
        F.array(F.struct(F.lit("contrast").alias("kind"), F.lit("at “a”").alias("location"), F.lit("done").alias("description"))).alias("applied"), F.when(key % 11 == 0, "2000-01-01T00:00:00Z").alias("delete_after"),
    )
    json = F.when(key % 5 == 0, F.concat(F.lit('{"id": '), F.substring(F.to_json(job), 1, 40))).when(key % 5 == 4, None).otherwise(F.to_json(job))
    return o.select(key.alias("key"), F.col("o_orderdate").cast("timestamp").alias("day"), json.alias("json"))


def record_versions(spark, sf_dir):
    """Records by version, with their findings; what can't be read is counted, too."""
    return records.read(job_records(spark, sf_dir)).groupBy("version").agg(F.count("*").alias("records"), F.sum(F.coalesce(F.size("findings"), F.lit(0))).cast("long").alias("findings"), F.count("unread").alias("unread"))


def record_refresh(spark, sf_dir):
    """Stale records detected again: a finding each, of which the first line's keeps its decision; what is current stays."""
    jobs = stored(records.read(job_records(spark, sf_dir)), "jobs")
    kept = F.struct(*[F.lit(None).cast(t).alias(n) for n, t in (f.split(" ", 1) for f in records.FINDING.split(", "))])
    first = F.get("findings", F.lit(1))
    finding = kept.withField("kind", first["kind"]).withField("anchor", first["anchor"])
    detected = jobs.where("version > 0").select("key", F.when(first.isNotNull(), F.array(finding)).otherwise(F.array()).alias("findings"), F.lit("scan").alias("tier"))
    out = records.refreshed(jobs, detected)
    return out.select("key", "version", "tier", F.size("findings").cast("long").alias("findings"), F.size(F.filter("findings", lambda f: f["decision"].isNotNull())).cast("long").alias("decided"))


def deliveries(spark, sf_dir):
    """Jobs after downloads of which some orders have several, and after the same downloads again."""
    rows = job_records(spark, sf_dir)
    jobs = records.read(rows).where("version > 0").drop("version", "unread")
    later = F.expr("transform(filter(array(3, 1, 2), d -> key % 4 >= d), d -> day + make_interval(0, 0, 0, d))")
    downloads = rows.select("key", F.explode(later).alias("at"))
    once = stored(records.delivered(jobs, downloads), "delivered")
    again = records.delivered(once, downloads.withColumn("at", F.col("at") + F.expr("INTERVAL 1 DAY")))
    said = F.array_join(F.transform("findings", lambda f: F.concat_ws("|", f["location"], f["description"], f["decision"]["value"], f["decision"]["note"], f["proposal"]["text"])), ";")
    return again.select("key", "delete_after", "scrubbed_at", said.alias("said"), F.get("applied", F.lit(0))["location"].alias("applied"))


def figure_sources(spark, sf_dir):
    """Order lines as figures: a drawing each, most with a relation of the document, of all sorts."""
    r = table(spark, sf_dir, "lineitem")
    embed = F.when(F.col("l_suppkey") % 6 == 0, None).when(F.col("l_suppkey") % 6 == 1, "rId99").otherwise(F.concat(F.lit("rId"), F.col("l_linenumber").cast("string")))
    drawings = r.select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("docPr:"), F.col("l_linenumber").cast("string")).alias("anchor"), (F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("pre"), embed.alias("embed"))
    at = lambda i: F.get(F.array(*[F.lit(t[i]) for t in TARGETS]), (F.col("n") % len(TARGETS)).cast("int"))
    ids = r.select(F.col("l_orderkey").alias("doc_id"), "l_linenumber").distinct().withColumn("n", F.col("doc_id") + F.col("l_linenumber"))
    relations = ids.select("doc_id", F.concat(F.lit("rId"), F.col("l_linenumber").cast("string")).alias("id"), at(0).alias("target"), at(1).alias("mode"), F.lit(0).alias("ord"))
    return figures.figure_sources(drawings, relations)


SECRETS = ("correct horse battery", "short", "", " PasswordPassword ", "a longer passphrase", "x" * 129)


def requests(spark, sf_dir):
    """Customers as requests for accounts: one address for seven of them, some bad, in no order of time."""
    k = F.col("c_custkey")
    email = F.when(k % 9 == 0, "not an address").when(k % 10 == 0, None).otherwise(F.concat(F.when(k % 2 == 0, "User").otherwise(" user"), F.floor(k / 7).cast("string"), F.lit("@example.org")))
    return table(spark, sf_dir, "customer").select(k.alias("seq"), (k * 7919 % 1000).alias("at"), email.alias("email"), F.get(F.array(*map(F.lit, SECRETS)), (k % 6).cast("int")).alias("password"))


def taken(spark, sf_dir):
    none = F.lit(None).cast("bigint")
    held = table(spark, sf_dir, "customer").where("c_custkey % 35 = 1").select(F.concat(F.lit("user"), F.floor(F.col("c_custkey") / 7).cast("string"), F.lit("@example.org")).alias("email"))
    return held.distinct().select(accounts.address_key(F.col("email")).alias("key"), "email", F.lit(0).cast("bigint").alias("created_at"), none.alias("changed_at"), none.alias("disabled_at"))


def account_requests(spark, sf_dir):
    return accounts.judged(requests(spark, sf_dir), taken(spark, sf_dir)).select("seq", "outcome", "reason")


def account_states(spark, sf_dir):
    """Accounts that requests create, after changes and disablings at times by seq."""
    rows = stored(accounts.created(taken(spark, sf_dir), requests(spark, sf_dir)), "accounts")
    n = F.regexp_extract("email", "([0-9]+)@", 1).cast("bigint")
    event = lambda when, at, what: F.when(when, F.struct(at.cast("bigint").alias("at"), F.lit(what).alias("event")))
    events = rows.select("key", F.explode(F.filter(F.array(event(n % 2 == 0, 1000 + n, "change"), event(n % 3 == 0, 2000 + n * 0, "disable"), event(n % 3 == 0, 3000 + n * 0, "disable"), event(n % 5 == 0, 2500 + n * 0, "change")), lambda e: e.isNotNull())).alias("e")).select("key", "e.*")
    return accounts.updated(rows, events).select("email", "created_at", "changed_at", "disabled_at")


def store_jobs(spark, sf_dir):
    """Keys of a store, a job for each order and two files, among others."""
    k = F.lpad(F.hex("o_orderkey"), 12, "0")
    ident = F.concat(F.lit("00000000-0000-4000-8000-"), F.when(F.col("o_orderkey") % 7 == 0, k).otherwise(F.lower(k)))
    keys = table(spark, sf_dir, "orders").select(F.explode(F.array(F.concat(ident, F.lit("/record.json")), F.concat(ident, F.lit("/original.docx")), F.concat(F.lit("audit/"), ident))).alias("key"))
    return records.job_keys(keys)


QUERIES = {f.__name__: f for f in (record_versions, record_refresh, deliveries, figure_sources, account_requests, account_states, store_jobs)}

KINDS_SQL = "['" + "', '".join(n for n, _ in catalog.KINDS) + "']"
LINES_SQL = f"""li AS (SELECT l_orderkey AS key, l_linenumber AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i, {KINDS_SQL}[(l_partkey % {len(catalog.KINDS)})::INT + 1] AS kind, l_suppkey AS s FROM lineitem),
jobs AS (SELECT o_orderkey AS key, o_orderdate::TIMESTAMP AS day, o_orderkey % 5 AS m, (SELECT count(*) FROM li WHERE li.key = o_orderkey) AS lines,
  CASE WHEN o_orderkey % 5 IN (0, 4) THEN 0 WHEN o_orderkey % 5 = 1 AND EXISTS (SELECT 1 FROM li WHERE li.key = o_orderkey AND n = 1) THEN 1 WHEN o_orderkey % 5 = 2 AND o_orderkey % 2 = 0 THEN 2 ELSE 3 END AS version FROM orders)"""
REQUESTS_SQL = f"""rq AS (SELECT c_custkey AS seq, c_custkey*7919 % 1000 AS at_, CASE WHEN c_custkey % 9 = 0 THEN 'not an address' WHEN c_custkey % 10 = 0 THEN '' ELSE 'user' || c_custkey // 7 || '@example.org' END AS email, c_custkey % 6 AS p FROM customer),
jd AS (SELECT *, CASE WHEN email = '' THEN 'missing' WHEN email NOT LIKE '%@%' THEN 'malformed' WHEN p = 1 THEN 'too-short' WHEN p = 2 THEN 'missing' WHEN p = 3 THEN 'common' WHEN p = 5 THEN 'too-long' END AS reason FROM rq),
tk AS (SELECT DISTINCT 'user' || c_custkey // 7 || '@example.org' AS email FROM customer WHERE c_custkey % 35 = 1),
wn AS (SELECT email, min(at_*100000000 + seq) AS w FROM jd WHERE reason IS NULL AND email NOT IN (SELECT email FROM tk) GROUP BY 1)"""
ORACLE_SQL = {
    "record_versions": f"WITH {LINES_SQL} SELECT version::INT AS version, count(*) AS records, sum(CASE WHEN version > 0 THEN lines ELSE 0 END)::BIGINT AS findings, count(*) FILTER (version = 0) AS unread FROM jobs GROUP BY 1",
    "record_refresh": f"""WITH {LINES_SQL}, dc AS (SELECT key, count(*) FILTER (s % 3 = 0) AS every, count(*) FILTER (i = 2 AND NOT (key % 5 = 1 AND n = 1) AND EXISTS (SELECT 1 FROM li b WHERE b.key = li.key AND b.n = li.n AND b.kind = li.kind AND b.s % 3 = 0)) AS second, count(*) FILTER (i = 2) AS has FROM li GROUP BY 1)
SELECT key, CASE WHEN version = 0 THEN 0 ELSE 3 END AS version, CASE WHEN version = 0 THEN NULL WHEN version = 3 AND m <> 2 THEN 'tagged' WHEN version = 3 THEN NULL ELSE 'scan' END AS tier,
CASE WHEN version = 0 THEN NULL WHEN version = 3 THEN lines ELSE coalesce(has, 0) END AS findings, CASE WHEN version = 0 THEN NULL WHEN version = 3 THEN coalesce(every, 0) ELSE coalesce(second, 0) END AS decided FROM jobs LEFT JOIN dc USING (key)""",
    "deliveries": f"""WITH {LINES_SQL}, t AS (SELECT key, key % 11 = 0 AS had, CASE WHEN key % 4 >= 1 THEN day + INTERVAL 1 DAY END AS at_ FROM jobs WHERE version > 0),
sc AS (SELECT t.*, at_ IS NOT NULL AND NOT had AS due, n, s, i FROM t LEFT JOIN li USING (key)),
sx AS (SELECT key, string_agg(CASE WHEN due THEN 'page ' || n || ' ([removed]) of it|It says [removed] and [removed].' || CASE WHEN s % 3 = 0 THEN '|[removed]' || CASE WHEN s % 2 = 0 THEN '|note [removed] y' ELSE '' END ELSE '' END || CASE WHEN s % 4 = 0 THEN '|[removed]' ELSE '' END
  ELSE 'page ' || n || ' (“quoted ' || n || '”) of it|It says “this” and “that”.' || CASE WHEN s % 3 = 0 THEN '|value ' || n || CASE WHEN s % 2 = 0 THEN '|note “x” y' ELSE '' END ELSE '' END || CASE WHEN s % 4 = 0 THEN '|draft ' || n ELSE '' END END, ';' ORDER BY i) AS said FROM sc GROUP BY 1)
SELECT key, CASE WHEN had THEN '2000-01-01T00:00:00Z' WHEN at_ IS NOT NULL THEN strftime(at_ + INTERVAL 7 DAYS, '%Y-%m-%dT%H:%M:%SZ') END AS delete_after, CASE WHEN NOT had AND at_ IS NOT NULL THEN strftime(at_, '%Y-%m-%dT%H:%M:%SZ') END AS scrubbed_at,
coalesce(said, '') AS said, CASE WHEN NOT had AND at_ IS NOT NULL THEN 'at [removed]' ELSE 'at “a”' END AS applied FROM t LEFT JOIN sx USING (key)""",
    "figure_sources": f"""WITH dr AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, arg_min(l_suppkey % 6, l_partkey*1000000 + l_suppkey) AS s FROM lineitem GROUP BY 1, 2),
x AS (SELECT doc_id, n, CASE WHEN s = 0 THEN 'none' WHEN s = 1 THEN 'unknown' ELSE {[t[4] or '' for t in TARGETS]}[((doc_id + n) % 10)::INT + 1] END AS why, ((doc_id + n) % 10)::INT + 1 AS i FROM dr)
SELECT doc_id, 'docPr:' || n AS anchor, CASE WHEN why = '' THEN {[t[2] or '' for t in TARGETS]}[i] END AS part, CASE WHEN why = '' THEN {[t[3] or '' for t in TARGETS]}[i] END AS media_type, nullif(why, '') AS reason FROM x""",
    "account_requests": f"""WITH {REQUESTS_SQL} SELECT seq, CASE WHEN reason IS NOT NULL AND (email = '' OR email NOT LIKE '%@%') THEN 'bad-email' WHEN reason IS NOT NULL THEN 'bad-password' WHEN at_*100000000 + seq = w THEN 'created' ELSE 'taken' END AS outcome, reason FROM jd LEFT JOIN wn USING (email)""",
    "account_states": f"""WITH {REQUESTS_SQL}, a AS (SELECT email, 0::BIGINT AS created_at FROM tk UNION ALL SELECT email, (w // 100000000)::BIGINT FROM wn), n AS (SELECT *, regexp_extract(email, '([0-9]+)@', 1)::BIGINT AS n FROM a)
SELECT email, created_at, CASE WHEN n % 5 = 0 AND n % 3 <> 0 THEN CASE WHEN n % 2 = 0 THEN greatest(2500, 1000 + n) ELSE 2500 END WHEN n % 2 = 0 AND (n % 3 <> 0 OR 1000 + n < 2000) THEN 1000 + n END AS changed_at, CASE WHEN n % 3 = 0 THEN 2000 END AS disabled_at FROM n""",
    "store_jobs": "SELECT '00000000-0000-4000-8000-' || lower(lpad(to_hex(o_orderkey), 12, '0')) AS job FROM orders WHERE o_orderkey % 7 <> 0 OR regexp_matches(lpad(to_hex(o_orderkey), 12, '0'), '^[0-9]+$')",
}
