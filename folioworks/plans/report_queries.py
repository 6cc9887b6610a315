"""Reports, queues and the small rules around jobs, on orders and lines as jobs and findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioworks.functions import text
from folioworks.operators import findings, reports
from folioworks.plans import catalog, lifecycle_queries, pdf_queries, surrogates, text_queries
from folioworks.plans.lifecycle_queries import HOLD_SQL, JOBS_SQL
from folioworks.tables import table

NAMES = ("Ann", "Bo", "", None)


def decided_findings(spark, sf_dir):
    """One finding for each job and line number, with who decided it."""
    name = F.get(F.array(*map(F.lit, NAMES)), (F.col("seq") % len(NAMES)).cast("int"))
    return surrogates.findings(spark, sf_dir).groupBy("job_id", "seq").agg(F.min(F.struct("kind", "severity", "remediated", "action", "location")).alias("f")).select("job_id", "seq", "f.*").withColumn("by", name)


def report_remarks(spark, sf_dir):
    found = decided_findings(spark, sf_dir)
    jobs = surrogates.jobs(spark, sf_dir)
    return reports.remarks(findings.assess_all(jobs, found), found).where("status in ('Partially Supports', 'Does Not Support', 'Supports')").select("job_id", "principle", "criterion", "remarks")


def review_queue(spark, sf_dir):
    return reports.queue(surrogates.findings(spark, sf_dir), ("table-header", "contrast"))


def access_rules(spark, sf_dir):
    """Each job and two viewers, one of them signed in where its number is even."""
    seen = surrogates.jobs(spark, sf_dir).select("job_id", "account", "visitor", F.explode(F.array(F.coalesce("account", "visitor", F.lit(-1)), F.lit(2))).alias("viewer"))
    account = F.when(F.col("viewer") % 2 == 0, F.col("viewer"))
    return seen.select("job_id", "viewer", reports.owner_of(F.col("account"), F.col("visitor")).alias("owner"), reports.may_claim(F.col("account"), F.col("visitor"), account, F.col("viewer")).alias("claims"), reports.may_review(account).alias("reviews")).distinct()


def decision_forms(spark, sf_dir):
    k = F.col("l_partkey")
    pick = lambda values, by: F.get(F.array(*map(F.lit, values)), (by % len(values)).cast("int"))
    problem = reports.form_problem(pick(NAMES, k), pick(("apply", "dismiss", "decorative", "other", None), F.col("l_suppkey")), pick(("A value", " ", None), F.col("l_orderkey")), pick(("A note", ""), F.col("l_linenumber")))
    return table(spark, sf_dir, "lineitem").groupBy(problem.alias("problem")).agg(F.count("*").alias("forms"), F.sum("l_partkey").alias("parts"))


def drafts_allowed(spark, sf_dir):
    jobs = surrogates.jobs(spark, sf_dir).where("job_id % 9 <> 0").select("job_id", (F.col("job_id") % 4 == 0).alias("cui"))
    return reports.draftable(surrogates.findings(spark, sf_dir), jobs).groupBy("reason").agg(F.count("*").alias("findings"), F.sum(F.col("job_id") * F.col("seq")).alias("product"))


def pdf_fixed(spark, sf_dir):
    facts = pdf_queries.facts(spark, sf_dir).withColumn("title", text.squeezed(F.col("title")))
    return reports.pdf_edits(facts, F.concat(F.lit("file  "), F.col("doc_id").cast("string")))


def pdf_described(spark, sf_dir):
    """Decisions on the tag trees' elements, some of numbers that no element has."""
    e = pdf_queries.elements(spark, sf_dir).where("tag = 'Figure'")
    n = F.col("num") + F.when(F.col("num") % 7 == 0, 1_000_000).otherwise(0)
    action = F.when(F.col("num") % 3 == 0, "decorative").when(F.col("num") % 3 == 1, "apply").otherwise("dismiss")
    decided = e.select("doc_id", F.lit("image-alt").alias("kind"), F.concat(F.lit("struct:"), n.cast("string")).alias("anchor"), action.alias("action"), F.when(F.col("num") % 2 == 0, F.concat(F.lit(" Figure "), "num")).alias("value")).distinct()
    return reports.pdf_descriptions(e, decided)


def figure_boxes(spark, sf_dir):
    """Order lines as figures with two boxes, of which the first can be too thin."""
    q, d = F.col("l_quantity"), F.col("l_discount")
    box = lambda *v: F.array(*[x.cast("double") for x in v])
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") * 100 + F.col("l_suppkey") % 100).alias("num"), F.when(F.col("l_suppkey") % 5 != 0, F.col("l_linenumber")).alias("page"), F.array(box(q, q, q + d * 20, q + 9), box(q, q, q + 5, q - F.col("l_suppkey") % 3)).alias("boxes"))
    return reports.figure_boxes(rows).select("doc_id", "num", "page", F.array_join(F.transform("box", lambda x: F.round(x * 100).cast("long").cast("string")), " ").alias("box"))


def dates_told(spark, sf_dir):
    """When jobs go, as sentences; their days as they are written, corrupt ones as given; minutes of a lock left."""
    rows = lifecycle_queries.with_due(spark, sf_dir).join(surrogates.jobs(spark, sf_dir).select("job_id", "created_at"), "job_id")
    now = lifecycle_queries.now()
    until = now + F.make_interval(secs=(F.col("job_id") % 1000).cast("int"))
    return rows.select("job_id", reports.retention_told(F.col("due_at"), F.col("clock"), F.when(F.col("gone"), now)).alias("told"), reports.written_date(F.col("created_at"), F.col("created_at")).alias("created"), reports.minutes_left(until, now).alias("minutes"))


def reset_consumed(spark, sf_dir):
    """Events as links, a user's later events as attempts at them; errors are refused and spend the link, too."""
    e = lifecycle_queries.event_times(spark, sf_dir)
    resets = e.where("event_type = 'signup'").select(F.col("user_id").alias("key"), F.col("event_id").alias("link"), F.when(F.col("event_id") % 5 == 0, F.col("ts")).alias("used_at"))
    attempts = e.where("event_type in ('error', 'click')").select(F.col("user_id").alias("key"), F.col("ts").alias("at"))
    return reports.consumed(resets, attempts).select("link", F.date_format("used_at", "yyyy-MM-dd HH:mm:ss").alias("used_at"))


def passphrase_gate(spark, sf_dir):
    k = F.col("c_custkey")
    secret = F.when(k % 8 == 0, F.concat(F.lit(" USER"), k.cast("string"), F.lit("@EXAMPLE.ORG "))).otherwise(F.get(F.array(*map(F.lit, ("", "short", "Administrator ", "508this12345", "a longer passphrase", "x" * 129, "é" * 12))), (k % 7).cast("int")))
    problem = text.password_problem(secret, F.concat(F.lit("user"), k.cast("string"), F.lit("@example.org")))
    return table(spark, sf_dir, "customer").select(k.alias("customer"), F.coalesce(problem, F.lit("ok")).alias("problem"))


def names_and_keys(spark, sf_dir):
    """Keys of findings, names of reviewers and of delivered files, digests of visitors."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    file = F.concat(F.when(k % 4 == 0, "").otherwise(F.col("c_name")), F.get(F.array(*map(F.lit, (".docx", ".a.pdf", ""))), (k % 3).cast("int")))
    return c.select(k.alias("customer"), text.finding_key(F.lit("contrast"), F.col("c_name")).alias("key"), text.reviewer_name(F.concat(F.lit("\t "), "c_name", F.lit("\n \x01 x "))).alias("reviewer"), F.concat(text.stem(file), F.lit(" (accessible)")).alias("delivered"), F.sha2(k.cast("string"), 256).alias("visitor"))


def files_found(spark, sf_dir):
    """Parts as files of a tree of folders, some too deep, some hidden."""
    k = F.col("p_partkey")
    folder = F.get(F.array(*map(F.lit, ("", "a/", "a/b/c/d/", "a/b/c/d/e/", ".git/", "a//b/"))), (k % 6).cast("int"))
    name = F.concat(F.when(k % 10 == 0, ".").otherwise(""), F.lit("f"), k.cast("string"), F.get(F.array(*map(F.lit, (".pdf", ".PDF", ".doc"))), (k % 3).cast("int")))
    return reports.found_files(table(spark, sf_dir, "part").select(F.lit("/in").alias("root"), F.concat(F.lit("/in/"), folder, name).alias("path"))).select("path")


def page_languages(spark, sf_dir):
    """Documents as pages, two to a document, whose language may be marked."""
    docs = table(spark, sf_dir, "documents")
    pages = docs.select(F.floor(F.col("doc_id") / 2).alias("doc_id"), (F.col("doc_id") % 2).alias("page"), "text", F.lit("en").alias("expected"))
    marked = docs.where("doc_id % 3 = 0").select(F.floor(F.col("doc_id") / 2).alias("doc_id"), F.concat("lang", F.lit("-XX")).alias("tag"))
    return reports.language_findings(pages, marked)


def page_prose(spark, sf_dir):
    """Sentences of `surrogates.PHRASES` as blocks, several to a page."""
    phrase = F.get(F.array(*map(F.lit, surrogates.PHRASES)), (F.col("l_partkey") % len(surrogates.PHRASES)).cast("int"))
    return reports.prose_findings(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 2).alias("page"), phrase.alias("text")))


QUERIES = {
    f.__name__: f
    for f in (report_remarks, review_queue, access_rules, decision_forms, drafts_allowed, pdf_fixed, pdf_described, figure_boxes, dates_told, reset_consumed, passphrase_gate, names_and_keys, files_found, page_languages, page_prose)
}

KINDS_SQL = "['" + "', '".join(n for n, _ in catalog.KINDS) + "']"
F_SQL = f"f AS (SELECT l_orderkey AS job_id, l_linenumber AS seq, {KINDS_SQL}[(l_partkey % {len(catalog.KINDS)})::INT + 1] AS kind, CASE WHEN l_quantity < 5 THEN 'blocking' ELSE 'partial' END AS severity, l_linestatus = 'F' AS remediated, CASE WHEN l_returnflag = 'A' THEN 'dismiss' END AS action, 'page ' || l_suppkey % 9 AS location FROM lineitem)"
CASES_SQL = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{c}'" for k, c in catalog.KINDS) + " END"
D_SQL = f"""{F_SQL}, d AS (SELECT job_id, seq, unnest(m) FROM (SELECT job_id, seq, min(struct_pack(kind := kind, severity := severity, remediated := remediated, action := coalesce(action, ''), location := location)) AS m FROM f GROUP BY 1, 2))"""
CRITERIA_SQL = ", ".join(f"({i + 1}, '{c}')" for i, (c, _, _) in enumerate(catalog.CRITERIA))
PRINCIPLE_SQL = "CASE substr(criterion, 1, 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in catalog.PRINCIPLES.items()) + " END"
EXEMPT_SQL = ", ".join(f"'{c}'" for c in catalog.EXEMPT)
REVIEWER_SQL = ", ".join(f"'{c}'" for c in catalog.REVIEWER)
DETECTED_SQL = text_queries.detect_sql("pg", "id", "expected")
PROSE_SQL = " UNION ALL ".join(
    [f"SELECT doc_id, page, '{k}' AS kind, {text_queries.phrase_sql('t', ps)} AS phrase, t AS sentence FROM b WHERE regexp_matches(t, '{text_queries.phrases.ENGLISH_PATTERNS.instruction}', 'i')" for k, ps in text_queries.phrases.ENGLISH_PATTERNS.senses.items()]
    + [f"SELECT doc_id, page, 'colour', coalesce({text_queries.phrase_sql('t', text_queries.phrases.ENGLISH_PATTERNS.colour)}, CASE WHEN regexp_matches(t, '{text_queries.phrases.ENGLISH_PATTERNS.stands}', 'i') THEN nullif(regexp_extract(t, '{text_queries.phrases.ENGLISH_PATTERNS.colours}', 0, 'i'), '') END), t FROM b"]
)
ORACLE_SQL = {
    "report_remarks": f"""WITH {D_SQL}, e AS (SELECT job_id, seq, {CASES_SQL} AS criterion, NOT remediated AND action = '' AS open, action = 'dismiss' AS gone, severity, location, nullif(['Ann', 'Bo', '', ''][(seq % 4)::INT + 1], '') AS who FROM d),
o AS (SELECT job_id, criterion, count(*) FILTER (open) AS n, count(*) FILTER (gone) AS g, string_agg(location, ', ' ORDER BY seq) FILTER (open) AS spots FROM e GROUP BY 1, 2),
w AS (SELECT job_id, criterion, string_agg(who, ', ' ORDER BY first) AS names FROM (SELECT job_id, criterion, who, min(seq) AS first FROM e WHERE gone AND who IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2),
c AS (SELECT o_orderkey AS job_id, criterion FROM orders, (VALUES {CRITERIA_SQL}) t(ord, criterion) WHERE criterion NOT IN ({EXEMPT_SQL})),
x AS (SELECT c.*, coalesce(n, 0) AS n, coalesce(g, 0) AS g, spots, names FROM c LEFT JOIN o USING (job_id, criterion) LEFT JOIN w USING (job_id, criterion)),
y AS (SELECT *, CASE WHEN g > 0 THEN ' ' || g || CASE WHEN g = 1 THEN ' finding' ELSE ' findings' END || ' dismissed' || coalesce(' by ' || names, '') || '.' ELSE '' END AS judged FROM x)
SELECT job_id, {PRINCIPLE_SQL} AS principle, criterion, CASE WHEN n > 0 THEN n || CASE WHEN n = 1 THEN ' issue' ELSE ' issues' END || ' open: ' || spots || '.' || judged ELSE 'Nothing open.' || judged END AS remarks FROM y WHERE n > 0 OR criterion NOT IN ({REVIEWER_SQL})""",
    "review_queue": f"WITH {F_SQL} SELECT job_id, count(*) FILTER (NOT remediated AND action IS NULL) AS to_decide, count(action) AS decided, count(*) FILTER (NOT remediated AND action IS NULL AND kind IN ('table-header', 'contrast')) AS fixable, count(*) FILTER (kind = 'image-alt') AS figures FROM f GROUP BY 1",
    "access_rules": f"""WITH {HOLD_SQL}, v AS (SELECT DISTINCT *, unnest([coalesce(account, visitor, -1), 2]) AS viewer FROM h)
SELECT DISTINCT job_id, viewer, CASE WHEN account IS NOT NULL THEN 'account:' || account WHEN visitor IS NOT NULL THEN 'visitor:' || visitor END AS owner, account IS NULL AND visitor IS NOT NULL AND viewer % 2 = 0 AND viewer = visitor AS claims, viewer % 2 = 0 AS reviews FROM v""",
    "decision_forms": """WITH x AS (SELECT l_partkey % 4 > 1 AS nameless, l_suppkey % 5 AS a, l_orderkey % 3 > 0 AS blank, l_linenumber % 2 = 1 AS mute, l_partkey AS p FROM lineitem)
SELECT CASE WHEN nameless THEN 'name' WHEN a > 2 THEN 'action' WHEN a = 0 AND blank THEN 'value' WHEN a = 1 AND mute THEN 'note' END AS problem, count(*) AS forms, sum(p)::BIGINT AS parts FROM x GROUP BY 1""",
    "drafts_allowed": f"WITH {F_SQL} SELECT CASE WHEN job_id % 9 = 0 THEN 'not-found' WHEN job_id % 4 = 0 THEN 'cui' WHEN remediated OR action IS NOT NULL OR kind <> 'image-alt' THEN 'not-found' END AS reason, count(*) AS findings, sum(job_id*seq)::BIGINT AS product FROM f GROUP BY 1",
    "pdf_fixed": """SELECT o_orderkey AS doc_id, 'Lang' AS entry, 'en-US' AS value FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT o_orderkey, 'Title', 'file ' || o_orderkey FROM orders WHERE o_custkey % 4 = 0 UNION ALL SELECT o_orderkey, 'DisplayDocTitle', 'true' FROM orders WHERE o_orderkey % 3 = 0""",
    "pdf_described": """SELECT DISTINCT l_orderkey AS doc_id, l_suppkey AS num, CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE 'Figure ' || l_suppkey END AS alt FROM lineitem WHERE l_partkey % 13 = 5 AND l_suppkey % 7 <> 0 AND (l_suppkey % 3 = 0 OR (l_suppkey % 3 = 1 AND l_suppkey % 2 = 0))""",
    "figure_boxes": """WITH x AS (SELECT l_orderkey AS doc_id, l_partkey*100 + l_suppkey % 100 AS num, l_linenumber AS page, l_quantity AS q, l_discount*20 AS w, l_suppkey % 3 AS h FROM lineitem WHERE l_suppkey % 5 <> 0)
SELECT doc_id, num, page, CASE WHEN (q + w) - q >= 1 THEN round(q*100)::BIGINT || ' ' || round(q*100)::BIGINT || ' ' || round((q + w)*100)::BIGINT || ' ' || round((q + 9)*100)::BIGINT ELSE round(q*100)::BIGINT || ' ' || round(q*100)::BIGINT || ' ' || round((q + 5)*100)::BIGINT || ' ' || round((q - h)*100)::BIGINT END AS box FROM x WHERE (q + w) - q >= 1 OR h >= 1""",
    "dates_told": f"""WITH {JOBS_SQL}, x AS (SELECT u.*, o_orderdate FROM u JOIN orders ON o_orderkey = job_id)
SELECT job_id, CASE WHEN job_id % 5 = 0 THEN 'Deleted on ' || strftime(now, '%-d %B %Y') || '.' WHEN due_at IS NULL THEN 'Kept while it is under review.' ELSE CASE clock WHEN 'downloaded' THEN 'Downloaded; deleted on ' WHEN 'uncollected' THEN 'Ready; to be collected by ' ELSE 'Assessed; deleted unless a review starts by ' END || strftime(due_at, '%-d %B %Y') || '.' END AS told,
CASE WHEN job_id % 11 = 0 THEN 'not a date' ELSE strftime(o_orderdate, '%B %-d, %Y') END AS created, greatest(1, ceil((job_id % 1000) / 60))::BIGINT AS minutes FROM x""",
    "reset_consumed": """WITH a AS (SELECT user_id, min(ts) AS at_ FROM events WHERE event_type IN ('error', 'click') GROUP BY 1) SELECT event_id AS link, strftime(least(CASE WHEN event_id % 5 = 0 THEN ts END, at_), '%Y-%m-%d %H:%M:%S') AS used_at FROM events LEFT JOIN a USING (user_id) WHERE event_type = 'signup'""",
    "passphrase_gate": "SELECT c_custkey AS customer, CASE WHEN c_custkey % 8 = 0 THEN 'same-as-email' ELSE ['missing', 'too-short', 'common', 'common', 'ok', 'too-long', 'ok'][(c_custkey % 7)::INT + 1] END AS problem FROM customer",
    "names_and_keys": """SELECT c_custkey AS customer, 'contrast|' || c_name AS key, c_name || ' x' AS reviewer, CASE WHEN c_custkey % 4 = 0 THEN CASE c_custkey % 3 WHEN 0 THEN '.docx' WHEN 1 THEN '.a' ELSE '' END ELSE c_name || CASE c_custkey % 3 WHEN 1 THEN '.a' ELSE '' END END || ' (accessible)' AS delivered, sha256(c_custkey::VARCHAR) AS visitor FROM customer""",
    "files_found": """SELECT '/in/' || ['', 'a/', 'a/b/c/d/', 'a/b/c/d/e/', '.git/', 'a//b/'][(p_partkey % 6)::INT + 1] || 'f' || p_partkey || ['.pdf', '.PDF', '.doc'][(p_partkey % 3)::INT + 1] AS path FROM part WHERE p_partkey % 10 <> 0 AND p_partkey % 6 NOT IN (3, 4) AND p_partkey % 3 <> 2""",
    "page_languages": f"""WITH pg AS (SELECT doc_id AS id, text, 'en' AS expected FROM documents), {DETECTED_SQL}, pl AS (SELECT id // 2 AS doc_id, id % 2 AS page, {text_queries.TOLD} AS detected FROM d)
SELECT DISTINCT pl.doc_id, page, detected, EXISTS (SELECT 1 FROM documents m WHERE m.doc_id % 3 = 0 AND m.doc_id // 2 = pl.doc_id AND lower(m.lang) = detected) AS marked FROM pl WHERE detected IS NOT NULL""",
    "page_prose": f"WITH b AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber % 2 AS page, {list(surrogates.PHRASES)}[(l_partkey % {len(surrogates.PHRASES)})::INT + 1] AS t FROM lineitem) SELECT DISTINCT * FROM ({PROSE_SQL}) WHERE phrase IS NOT NULL",
}
