"""One query for each operator, over its whole table."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioworks.llm import ann, decontam, html_text, langid, line_dedup, merkle, ngram_join, packing, pii, repair, secrets, sql, tool_calls, toxicity
from folioworks.tables import stored, table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(langid.remainder("doc_id", 5) != 0))
    told = langid.identify(docs.select("doc_id", "text"), model)
    return told.select("doc_id", (langid.remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "margin", "ambiguous")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [pii.count_of(k, F.col("pii")).alias(f"n_{k}") for k in pii.BASE_KINDS]
    base = F.sha2(pii.digest(pii.BASE_KINDS, F.col("pii")), 256).alias("base_sha256")
    return found.select("doc_id", *counts, base, pii.digest(pii.KINDS, F.col("pii")).alias("spans"), pii.count_of("iban", F.col("pii")).alias("n_iban"), F.array_max(F.transform("pii", lambda s: s["score"])).alias("best_score"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [pii.count_of(k, F.col("secrets")).alias(f"n_{k}") for k in secrets.BASE_KINDS]
    base = F.sha2(pii.digest(secrets.BASE_KINDS, F.col("secrets")), 256).alias("base_sha256")
    return found.select("doc_id", *counts, base, pii.digest((*secrets.BASE_KINDS, "entropy"), F.col("secrets")).alias("spans"), pii.count_of("entropy", F.col("secrets")).alias("n_entropy"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_calls.calls_of_turns(table(spark, sf_dir, "conversations"))
    linked = tool_calls.link_all(calls, results, tool_calls.reply_parameters(spark))
    return linked.select("conv_id", "call_id", "turn", "result_turn", "results", "repeated", "level", "place", F.array_join("faults", "; ").alias("faults"), "record")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), every=100)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = ngram_join.link_documents(table(spark, sf_dir, "documents"))
    return linked.select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), langid.remainder("doc_id", 3) == 1
    model = toxicity.fit(docs.where(~held_out), table(spark, sf_dir, "labels").where(~held_out))
    return toxicity.score_documents(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    gone = line_dedup.later_copies(docs).groupBy("doc").agg(F.count("*").alias("removed"), F.array_join(F.sort_array(F.collect_set("no")), ",").alias("removed_lines"))
    lines = docs.select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines"))
    out = lines.join(gone, F.col("doc_id") == F.col("doc"), "left")
    return out.select("doc_id", "n_lines", F.coalesce("removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed_lines", F.lit("")).alias("removed_lines"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third row or so is tampered with: its text in lower case (A to Z only)."""
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate("text", ascii_uppercase, ascii_lowercase))
    told = merkle.manifest(table(spark, sf_dir, "documents"), "lang", "doc_id", ["doc_id", "source", "lang", "n_chars", "text"], tampered)
    back = merkle.folded(F.coalesce("altered_leaf", "leaf"), F.col("path"))
    out = told.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), back.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with a fault in about a quarter of the rows, by conversation and turn."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    text = F.when(how == 1, "").when(how == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    times = F.explode(F.when(how == 0, F.array().cast("array<int>")).when(how == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(how == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), times.alias("time")).drop("time")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    turns = repair.in_order(damaged(rows))
    found = stored(repair.faults(turns), "faults")
    edits = stored(repair.edited(found), "edits")
    told = repair.report(found).join(repair.costs(found, edits), "conv").join(repair.rendered(repair.repaired(turns, edits)), "conv")
    all_ = rows.groupBy("conv_id").agg(F.count("*").alias("rows")).withColumn("conv", repair.conversation(F.col("conv_id")))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    numbers = map(count, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return all_.join(told, "conv", "left").select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    told = html_text.extract(pages, html_text.fit(pages))
    return told.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_decontamination": op2_decontamination,
    "op3_language_id": op3_language_id,
    "op4_tool_calls": op4_tool_calls,
    "op5_pii": op5_pii,
    "op6_nearest": op6_nearest,
    "op7_ngram_join": op7_ngram_join,
    "op8_toxicity": op8_toxicity,
    "op9_secrets": op9_secrets,
    "op10_line_dedup": op10_line_dedup,
    "op11_merkle": op11_merkle,
    "op12_repair": op12_repair,
    "op13_main_text": op13_main_text,
}

#: op11 in SQL: crc32 by its table, trees level by level, paths as lists of `left|right` digests.
FIELD_SQL = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
LEAF_SQL = "sha256(" + " || ".join(FIELD_SQL.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
PLACED_SQL = """SELECT *, coalesce(string_agg(d, '') OVER (PARTITION BY {by}, h, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') || '|' ||
coalesce(string_agg(d, '') OVER (PARTITION BY {by}, h, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS beside FROM {nodes} WHERE n > 1"""
ORACLE_SQL: dict[str, str] = {
    **sql.ORACLE_SQL,
    "op4_tool_calls": sql.TOOL_CALLS,
    "op11_merkle": f"""WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))) AS t),
c AS (SELECT d.*, coalesce(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 3 = 0, false) AS bad FROM documents d, t),
l AS (SELECT doc_id, lang, {LEAF_SQL.format(text="text")} AS leaf, CASE WHEN bad THEN {LEAF_SQL.format(text=f"translate(text, '{ascii_uppercase}', '{ascii_lowercase}')")} END AS altered FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM l),
up AS (SELECT lang, 0 AS h, i, n, leaf AS d FROM r UNION ALL SELECT lang, h + 1, i // 8, (n + 7) // 8, sha256(string_agg(d, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY lang, h, i // 8, n),
s AS (SELECT lang, d AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (SELECT 0 AS h, i, n, subroot AS d FROM s UNION ALL SELECT h + 1, i // 8, (n + 7) // 8, sha256(string_agg(d, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY h, i // 8, n),
pl AS ({PLACED_SQL.format(by="lang", nodes="up")}), pt AS ({PLACED_SQL.format(by="n", nodes="top")}),
ps AS (SELECT s.lang, subroot, coalesce(list(beside ORDER BY h) FILTER (beside IS NOT NULL), []) AS above FROM s LEFT JOIN pt ON pt.i = s.i // power(8, h)::BIGINT GROUP BY 1, 2),
pr AS (SELECT r.doc_id, r.lang, r.i, leaf, altered, coalesce(list(beside ORDER BY h) FILTER (beside IS NOT NULL), []) AS below FROM r LEFT JOIN pl ON pl.lang IS NOT DISTINCT FROM r.lang AND pl.i = r.i // power(8, h)::BIGINT GROUP BY ALL),
x AS (SELECT doc_id, leaf, altered, subroot, list_concat(below, above) AS path FROM pr JOIN ps ON ps.lang IS NOT DISTINCT FROM pr.lang),
f AS (SELECT *, (SELECT d FROM top WHERE n = 1) AS root, list_reduce(list_prepend(coalesce(altered, leaf), path), lambda a, b: sha256(split_part(b, '|', 1) || a || split_part(b, '|', 2))) AS folded_root FROM x)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(path, ''), '|', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM f""",
}
