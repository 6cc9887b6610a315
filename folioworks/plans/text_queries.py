"""Text, language, phrases and web pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioworks.functions import language, phrases, text
from folioworks.plans import surrogates
from folioworks.tables import table


def token_counts(spark, sf_dir):
    words = text.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(words).cast("long").alias("tokens"), F.size(F.array_distinct(words)).cast("long").alias("distinct_tokens"))


def detect_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return language.detect_language(docs, "text", F.lit("en")).select("doc_id", "detected")


def language_vs_declared(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    found = language.detect_language(docs, "text", language.primary_subtag(F.col("lang")))
    return found.groupBy("lang", F.coalesce("detected", F.lit("none")).alias("detected")).agg(F.count("*").alias("documents"))


def language_parts(spark, sf_dir):
    """Conversations as documents and turns as pages: once for each page and language other than the document's."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    found = language.detect_language(turns, "text", F.lit("en")).where("detected is not null")
    return found.groupBy("conv_id", "turn", "detected").agg(F.count("*").alias("passages")).select("conv_id", "turn", "detected")


def sentences(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    split = text.sentences(F.col("text"))
    return docs.select("doc_id", F.size(split).cast("long").alias("sentences"), F.coalesce(F.array_max(F.transform(split, F.length)), F.lit(0)).cast("long").alias("longest"))


def sensory_screen(spark, sf_dir):
    hits = surrogates.phrased(spark, sf_dir).select("doc_id", F.explode(phrases.sensory_hits(F.col("text"))).alias("h"))
    return hits.select("doc_id", "h.kind", "h.phrase", "h.sentence").distinct()


def colour_screen(spark, sf_dir):
    hits = surrogates.phrased(spark, sf_dir).select("doc_id", F.explode(phrases.colour_hits(F.col("text"))).alias("h"))
    return hits.select("doc_id", "h.kind", "h.phrase", "h.sentence").distinct()


def scrub_quotes(spark, sf_dir):
    docs = surrogates.phrased(spark, sf_dir)
    clean = text.scrub_quotes(F.col("text"))
    return docs.select("doc_id", text.has_quotation(F.col("text")).alias("quoted"), F.sha2(clean, 256).alias("scrubbed_sha256"))


OPENERS = ("Image of ", "A photograph showing ", "“", "Sorry, ", "the chart of ", "")


def draft_normalise(spark, sf_dir):
    opener = F.get(F.array(*map(F.lit, OPENERS)), (F.col("doc_id") % len(OPENERS)).cast("int"))
    draft = text.normalised_draft(F.concat(opener, F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", draft.alias("draft"), (draft == "").alias("refused"))


def upload_gate(spark, sf_dir):
    k = F.col("doc_id")
    name = F.when(k % 13 == 0, "").otherwise(F.concat(F.lit("file"), k.cast("string"), F.get(F.array(*map(F.lit, (".docx", ".PDF", ".txt", ".pdf"))), (k % 4).cast("int"))))
    size = F.col("n_chars") * F.when(k % 17 == 0, 100000).otherwise(1) * F.when(k % 19 == 0, 0).otherwise(1)
    head = F.when(k % 4 == 0, "504b0304").when(k % 5 == 0, "00000000").otherwise("25504446")
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(text.upload_problem(name, size, head), F.lit("ok")).alias("problem"))


def email_gate(spark, sf_dir):
    k = F.col("c_custkey")
    mail = F.when(k % 7 == 0, "  ").when(k % 5 == 0, F.concat(F.col("c_name"), F.lit("@nowhere"))).otherwise(F.concat(F.lit(" "), F.lower(F.regexp_replace("c_name", "[^A-Za-z0-9]", ".")), F.lit("@Example.ORG ")))
    return table(spark, sf_dir, "customer").select("c_custkey", text.normalised_email(mail).alias("email"), F.coalesce(text.email_problem(mail), F.lit("ok")).alias("problem"))


def money(spark, sf_dir):
    cents = F.round(F.col("p_retailprice") * 100).cast("long") * (F.col("p_size") % 5).cast("long")
    return table(spark, sf_dir, "part").select("p_partkey", cents.alias("cents"), text.money(cents).alias("price"))


LINK = r'<a\s[^>]*href="([^"]*)"[^>]*>([^<]*)</a>'
GENERIC = r"(?i)^(click here|here|read more|more|link|this link|learn more)$"


def link_text_web(spark, sf_dir):
    """Links of pages whose text says nothing, or is a bare address; for each page, one such link is added by its id."""
    more = F.get(F.array(F.lit('<a href="/x">here</a>'), F.lit('<a href="/y">www.example.org/y</a>'), F.lit('<a href="/z">Annual report</a>')), (F.col("page_id") % 3).cast("int"))
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract_all(F.concat("html", more), F.lit(LINK), F.lit(2)).alias("links"))
    links = pages.select("page_id", F.posexplode("links").alias("place", "label")).select("page_id", "place", F.trim("label").alias("label"))
    fault = F.when(F.col("label") == "", "empty").when(F.col("label").rlike(GENERIC), "generic").when(F.col("label").rlike(r"(?i)^(https?://|www\.)\S+$"), "address")
    return links.select("page_id", F.col("place").cast("long").alias("place"), "label", fault.alias("fault")).where("fault is not null")


def page_title_lang_web(spark, sf_dir):
    title = F.trim(F.regexp_extract("html", r"(?i)<title[^>]*>([^<]*)</title>", 1))
    lang = F.regexp_extract("html", r'(?i)<html[^>]*\slang="([^"]*)"', 1)
    return table(spark, sf_dir, "pages").select("page_id", (title == "").alias("no_title"), (lang == "").alias("no_language"), language.primary_subtag(lang).alias("language"))


QUERIES = {
    "tokens": token_counts,
    "detect_language": detect_language,
    "language_vs_declared": language_vs_declared,
    "language_parts": language_parts,
    "sentences": sentences,
    "sensory_screen": sensory_screen,
    "colour_screen": colour_screen,
    "scrub_quotes": scrub_quotes,
    "draft_normalise": draft_normalise,
    "upload_gate": upload_gate,
    "email_gate": email_gate,
    "money": money,
    "link_text_web": link_text_web,
    "page_title_lang_web": page_title_lang_web,
}

TOKENS_SQL = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{M}'']+'), lambda w: w <> '')"


def detect_sql(source: str, key: str, expected: str) -> str:
    """Shares of function words; the scripts never decide on these tables."""
    lists = [(lang, w, i) for i, (lang, ws) in enumerate(language.FUNCTION_WORDS.items()) for w in dict.fromkeys(ws.split())]
    values = ", ".join(f"('{lang}', '{w}', {i})" for lang, w, i in lists)
    return f"""w(lang, word, i) AS (VALUES {values}),
t AS (SELECT {key}, {expected} AS expected, unnest({TOKENS_SQL}) AS word FROM {source}),
c AS (SELECT {key}, expected, word, count(*) AS k FROM t GROUP BY ALL),
n AS (SELECT {key}, sum(k) AS n FROM c GROUP BY ALL),
l AS (SELECT DISTINCT lang, i FROM w),
s AS (SELECT n.*, l.lang, l.i FROM n CROSS JOIN l),
h AS (SELECT {key}, lang, sum(k) AS hits FROM c JOIN w USING (word) GROUP BY ALL),
sh AS (SELECT s.*, coalesce(hits, 0) / n AS share FROM s LEFT JOIN h USING ({key}, lang)),
rk AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY share DESC, i) AS r FROM sh),
e AS (SELECT DISTINCT {key}, expected FROM c),
d AS (SELECT {key}, any_value(expected) AS expected, any_value(n) AS n, max(CASE WHEN r = 1 THEN lang END) AS best, max(CASE WHEN r = 1 THEN share END) AS s1, max(CASE WHEN r = 2 THEN share END) AS s2,
  coalesce(max(CASE WHEN lang = expected THEN share END), 0) AS own FROM rk JOIN e USING ({key}) GROUP BY ALL)"""


TOLD = "CASE WHEN n >= 20 AND best <> expected AND s1 >= 0.12 AND s1 >= greatest(own, s2)*1.5 THEN best END"
PHRASES_SQL = "['" + "', '".join(p.replace("'", "''") for p in surrogates.PHRASES) + "']"
PHRASED_SQL = f"p AS (SELECT doc_id, text || ' ' || {PHRASES_SQL}[(doc_id % {len(surrogates.PHRASES)})::INT + 1] AS text FROM documents)"
WHITE = r"[\t\n\x0B\f\r ]"
SPLIT_SQL = rf"list_filter(list_transform(string_split(regexp_replace(text, '([.!?]){WHITE}+([A-Z\"“(])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))), lambda s: s <> '')"


def phrase_sql(text_: str, patterns) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({text_}, '{p.replace(chr(39), chr(39) * 2)}', 0, 'i'), '')" for p in patterns) + ")"


def sensory_sql() -> str:
    kinds = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, {phrase_sql('sentence', ps)} AS phrase, sentence FROM i" for k, ps in phrases.ENGLISH_PATTERNS.senses.items())
    return f"WITH {PHRASED_SQL}, s AS (SELECT doc_id, unnest({SPLIT_SQL}) AS sentence FROM p), i AS (SELECT * FROM s WHERE regexp_matches(sentence, '{phrases.ENGLISH_PATTERNS.instruction}', 'i')) SELECT DISTINCT * FROM ({kinds}) WHERE phrase IS NOT NULL"


def colour_sql() -> str:
    pair = f"CASE WHEN regexp_matches(sentence, '{phrases.ENGLISH_PATTERNS.stands}', 'i') THEN nullif(regexp_extract(sentence, '{phrases.ENGLISH_PATTERNS.colours}', 0, 'i'), '') END"
    return f"WITH {PHRASED_SQL}, s AS (SELECT doc_id, unnest({SPLIT_SQL}) AS sentence FROM p) SELECT DISTINCT doc_id, 'colour' AS kind, coalesce({phrase_sql('sentence', phrases.ENGLISH_PATTERNS.colour)}, {pair}) AS phrase, sentence FROM s WHERE phrase IS NOT NULL"


ORACLE_SQL = {
    "tokens": f"SELECT doc_id, len({TOKENS_SQL}) AS tokens, len(list_distinct({TOKENS_SQL})) AS distinct_tokens FROM documents",
    "detect_language": f"WITH {detect_sql('documents', 'doc_id', chr(39) + 'en' + chr(39))} SELECT doc_id, {TOLD} AS detected FROM documents LEFT JOIN d USING (doc_id)",
    "language_vs_declared": f"WITH {detect_sql('documents', 'doc_id', 'lower(lang)')} SELECT lang, coalesce({TOLD}, 'none') AS detected, count(*) AS documents FROM documents LEFT JOIN d USING (doc_id) GROUP BY ALL",
    "language_parts": f"WITH c0 AS (SELECT conv_id*1000 + turn AS place, text FROM conversations), {detect_sql('c0', 'place', chr(39) + 'en' + chr(39))} SELECT place // 1000 AS conv_id, place % 1000 AS turn, {TOLD} AS detected FROM d WHERE detected IS NOT NULL",
    "sentences": f"SELECT doc_id, len({SPLIT_SQL}) AS sentences, coalesce(list_max(list_transform({SPLIT_SQL}, lambda s: length(s))), 0) AS longest FROM documents",
    "sensory_screen": sensory_sql(),
    "colour_screen": colour_sql(),
    "scrub_quotes": f"WITH {PHRASED_SQL} SELECT doc_id, regexp_matches(text, '“[\\s\\S]*?”') AS quoted, sha256(regexp_replace(text, '“[\\s\\S]*?”', '[removed]', 'g')) AS scrubbed_sha256 FROM p",
    "upload_gate": """WITH u AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN '' ELSE 'file' || doc_id || ['.docx', '.PDF', '.txt', '.pdf'][(doc_id % 4)::INT + 1] END AS name,
  n_chars * CASE WHEN doc_id % 17 = 0 THEN 100000 ELSE 1 END * CASE WHEN doc_id % 19 = 0 THEN 0 ELSE 1 END AS size,
  CASE WHEN doc_id % 4 = 0 THEN '504B0304' WHEN doc_id % 5 = 0 THEN '00000000' ELSE '25504446' END AS head FROM documents)
SELECT doc_id, CASE WHEN name = '' THEN 'missing' WHEN size = 0 THEN 'empty' WHEN NOT (lower(name) LIKE '%.docx' OR lower(name) LIKE '%.pdf') THEN 'unsupported' WHEN size > 26214400 THEN 'too-large'
  WHEN head <> CASE WHEN lower(name) LIKE '%.docx' THEN '504B0304' ELSE '25504446' END THEN 'wrong-content' ELSE 'ok' END AS problem FROM u""",
    "email_gate": """WITH m AS (SELECT c_custkey, lower(trim(CASE WHEN c_custkey % 7 = 0 THEN '  ' WHEN c_custkey % 5 = 0 THEN c_name || '@nowhere' ELSE ' ' || lower(regexp_replace(c_name, '[^A-Za-z0-9]', '.', 'g')) || '@Example.ORG ' END)) AS email FROM customer)
SELECT c_custkey, email, CASE WHEN email = '' THEN 'missing' WHEN length(email) > 254 THEN 'too-long' WHEN NOT regexp_matches(email, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$') THEN 'malformed' ELSE 'ok' END AS problem FROM m""",
    "money": """WITH c AS (SELECT p_partkey, round(p_retailprice*100)::BIGINT * (p_size % 5) AS cents FROM part)
SELECT p_partkey, cents, CASE WHEN cents = 0 THEN 'Free' WHEN cents % 100 = 0 THEN '$' || (cents // 100) ELSE '$' || printf('%.2f', cents/100) END AS price FROM c""",
    "link_text_web": """WITH l AS (SELECT page_id, regexp_extract_all(html || ['<a href="/x">here</a>', '<a href="/y">www.example.org/y</a>', '<a href="/z">Annual report</a>'][(page_id % 3)::INT + 1], '<a\\s[^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 2) AS links FROM pages),
u AS (SELECT page_id, unnest(links) AS label, generate_subscripts(links, 1) - 1 AS place FROM l)
SELECT page_id, place, trim(label) AS label, CASE WHEN trim(label) = '' THEN 'empty' WHEN regexp_matches(trim(label), '^(click here|here|read more|more|link|this link|learn more)$', 'i') THEN 'generic' WHEN regexp_matches(trim(label), '^(https?://|www\\.)\\S+$', 'i') THEN 'address' END AS fault FROM u WHERE fault IS NOT NULL""",
    "page_title_lang_web": """SELECT page_id, trim(regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1, 'i')) = '' AS no_title, regexp_extract(html, '<html[^>]*\\slang="([^"]*)"', 1, 'i') = '' AS no_language,
  lower(regexp_split_to_array(regexp_extract(html, '<html[^>]*\\slang="([^"]*)"', 1, 'i'), '[-_]')[1]) AS language FROM pages""",
}
