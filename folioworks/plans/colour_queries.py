"""Contrast."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioworks.functions import colour
from folioworks.operators import painted
from folioworks.plans import surrogates
from folioworks.tables import table


def part_colours(spark, sf_dir):
    bg = F.get(F.array(*map(F.lit, surrogates.BACKGROUNDS)), F.col("p_size") % 4)
    return table(spark, sf_dir, "part").select("p_partkey", colour.from_number(F.col("p_partkey") * 7919 % 16777216).alias("fg"), colour.from_number(bg).alias("bg"), (F.col("p_size") * 1.0).alias("points"), (F.col("p_partkey") % 2 == 0).alias("bold"))


def contrast_ratio(spark, sf_dir):
    rows = part_colours(spark, sf_dir)
    ratio, least = colour.contrast(F.col("fg"), F.col("bg")), colour.minimum_ratio(F.col("points"), F.col("bold"))
    return rows.select("p_partkey", colour.to_hex(F.col("fg")).alias("fg"), colour.to_hex(F.col("bg")).alias("bg"), F.round(ratio, 6).alias("ratio"), least.alias("minimum"), (ratio >= least).alias("passes"))


def contrast_findings(spark, sf_dir):
    found = painted.contrast_findings(surrogates.runs(spark, sf_dir))
    return found.select("doc_id", "page", "fg", "bg", "ord", "text", F.round("ratio", 6).alias("ratio"), "minimum")


def pixel_mode(spark, sf_dir):
    """Pixels of a run for each part: a block of paper, some ink, by its numbers."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("run_id"), F.explode(F.sequence(F.lit(0), F.lit(19))).alias("i"))
    value = lambda k: F.when(F.col("i") < 14, (F.col("run_id") * k) % 64 + 192).when(F.col("i") < 18, (F.col("run_id") * k) % 48).otherwise(128)
    pixels = rows.select("run_id", *[value(k).cast("int").alias(c) for c, k in (("r", 7), ("g", 11), ("b", 13))])
    return painted.paper_and_ink(pixels).select("run_id", "paper", F.round("share", 6).alias("share"), "ink")


def colour_adjusted(spark, sf_dir):
    rows = part_colours(spark, sf_dir)
    least = colour.minimum_ratio(F.col("points"), F.col("bold"))
    return rows.select("p_partkey", colour.to_hex(colour.adjusted(F.col("fg"), F.col("bg"), least)).alias("adjusted"))


CHANNEL = "(CASE WHEN {0}/255.0 <= 0.03928 THEN {0}/255.0/12.92 ELSE pow(({0}/255.0+0.055)/1.055, 2.4) END)"


def lum(n: str) -> str:
    part = lambda d: CHANNEL.format(f"(({n})//{d}%256)")
    return f"(0.2126*{part(65536)} + 0.7152*{part(256)} + 0.0722*{part(1)})"


def ratio_sql(a: str, b: str) -> str:
    return f"((greatest({lum(a)}, {lum(b)}) + 0.05) / (least({lum(a)}, {lum(b)}) + 0.05))"


BG_SQL = f"[{', '.join(map(str, surrogates.BACKGROUNDS))}]"
PARTS_SQL = f"parts AS (SELECT p_partkey, p_partkey*7919 % 16777216 AS f, {BG_SQL}[(p_size % 4)::INT + 1] AS g, p_size >= 18 OR (p_partkey % 2 = 0 AND p_size >= 14) AS large FROM part)"
HEX = "upper(lpad(to_hex({0}), 6, '0'))"
RUNS_SQL = f"""runs AS (SELECT l_orderkey AS doc_id, 1 AS page,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)::INT AS ord,
  'part ' || l_partkey AS text, l_quantity AS points, l_returnflag = 'R' AS bold, 0.5 + 2*l_discount AS share,
  l_partkey*7919 % 16777216 AS f, {BG_SQL}[(l_suppkey % 4)::INT + 1] AS g, l_partkey, l_suppkey, l_quantity FROM lineitem)"""

QUERIES = {"contrast_ratio": contrast_ratio, "contrast_findings": contrast_findings, "pixel_mode": pixel_mode, "colour_adjusted": colour_adjusted}

# A colour on the way from f to e.
MIX = "(floor(({n})//{d}%256 + (({e}) - ({n})//{d}%256)*{t} + 0.5)::BIGINT)"


def mix_sql(share: str) -> str:
    return "(" + " + ".join(MIX.format(n="f", d=d, e="e", t=share) + f"*{d}" for d in (65536, 256, 1)) + ")"

ORACLE_SQL = {
    "colour_adjusted": f"""WITH RECURSIVE {PARTS_SQL}, r AS (SELECT p_partkey, f, g, CASE WHEN {lum('g')} > 0.5 THEN 0 ELSE 255 END AS e, CASE WHEN large THEN 3.0 ELSE 4.5 END AS m, {ratio_sql('f', 'g')} AS x FROM parts),
b AS (SELECT *, 0 AS k, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high FROM r WHERE x < m
  UNION ALL SELECT p_partkey, f, g, e, m, x, k + 1, CASE WHEN {ratio_sql('c', 'g')} >= m THEN low ELSE (low + high)/2 END, CASE WHEN {ratio_sql('c', 'g')} >= m THEN (low + high)/2 ELSE high END FROM (SELECT *, {mix_sql('((low + high)/2)')} AS c FROM b WHERE k < 24)),
t AS (SELECT p_partkey, g, m, n, {mix_sql('least(1.0, high + n/255.0)')} AS c FROM b, range(256) u(n) WHERE k = 24 AND n < 4),
w AS (SELECT p_partkey, arg_min(c, n) AS c FROM t WHERE {ratio_sql('c', 'g')} >= m GROUP BY 1)
SELECT p_partkey, {HEX.format('CASE WHEN x >= m THEN f ELSE coalesce(c, e*65793) END')} AS adjusted FROM r LEFT JOIN w USING (p_partkey)""",
    "contrast_ratio": f"""WITH {PARTS_SQL}, r AS (SELECT *, {ratio_sql('f', 'g')} AS x, CASE WHEN large THEN 3.0 ELSE 4.5 END::DOUBLE AS m FROM parts)
SELECT p_partkey, {HEX.format('f')} AS fg, {HEX.format('g')} AS bg, round(x, 6) AS ratio, m AS minimum, x >= m AS passes FROM r""",
    "contrast_findings": f"""WITH {RUNS_SQL}, j AS (SELECT *, CASE WHEN points >= 18 OR (bold AND points >= 14) THEN 3.0 ELSE 4.5 END::DOUBLE AS m,
  CASE WHEN share >= 0.6 THEN {ratio_sql('f', 'g')} END AS x FROM runs),
k AS (SELECT doc_id, page, ord, text, x, m, CASE WHEN x IS NOT NULL THEN {HEX.format('f')} END AS fg, CASE WHEN x IS NOT NULL THEN {HEX.format('g')} END AS bg FROM j WHERE x IS NULL OR x < m)
SELECT doc_id, page, fg, bg, ord, text, round(x, 6) AS ratio, m AS minimum FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page, fg, bg ORDER BY ord) AS n FROM k) WHERE n = 1""",
    "pixel_mode": """WITH px AS (SELECT p_partkey AS run_id, i, CASE WHEN i < 14 THEN p_partkey*7 % 64 + 192 WHEN i < 18 THEN p_partkey*7 % 48 ELSE 128 END AS r,
  CASE WHEN i < 14 THEN p_partkey*11 % 64 + 192 WHEN i < 18 THEN p_partkey*11 % 48 ELSE 128 END AS g,
  CASE WHEN i < 14 THEN p_partkey*13 % 64 + 192 WHEN i < 18 THEN p_partkey*13 % 48 ELSE 128 END AS b FROM part, range(20) t(i)),
bk AS (SELECT run_id, r//16*256 + g//16*16 + b//16 AS code, count(*) AS n, round(avg(r))::BIGINT*65536 + round(avg(g))::BIGINT*256 + round(avg(b))::BIGINT AS c FROM px GROUP BY ALL),
pp AS (SELECT run_id, sum(n) AS pixels, arg_max(struct_pack(c := c, code := code, n := n), n*10000 - code) AS p FROM bk GROUP BY 1),
ik AS (SELECT bk.run_id, arg_max(bk.c, round(abs(LC - LP), 9)*1e6 - bk.code/1e6) AS c FROM bk JOIN pp ON bk.run_id = pp.run_id AND bk.code <> pp.p.code AND bk.n >= greatest(2, pp.pixels*0.02) GROUP BY 1)
SELECT pp.run_id, HP AS paper, round(pp.p.n / pp.pixels, 6) AS share, HI AS ink FROM pp LEFT JOIN ik USING (run_id)""".replace("LC", lum("bk.c")).replace("LP", lum("pp.p.c")).replace("HP", HEX.format("pp.p.c")).replace("HI", HEX.format("ik.c")),
}
