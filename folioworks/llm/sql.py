"""SQL counterparts of the operators on spans and copies, in DuckDB's dialect: they check whole tables of a small scale."""

from __future__ import annotations

from folioworks.llm import line_dedup, pii, secrets

TEXT = "t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)"


def spans(name: str, kinds: dict[str, str]) -> str:
    """CTE `name` (doc_id, t, kind, m, a, b): matches of the patterns by kind. Where each begins follows from the pieces between them."""
    found = " UNION ALL ".join(
        f"""SELECT doc_id, t, '{kind}' AS kind, unnest(string_split_regex(t, $re${pattern}$re$)[:-2]) AS gap, unnest(regexp_extract_all(t, $re${pattern}$re$)) AS m,
generate_subscripts(regexp_extract_all(t, $re${pattern}$re$), 1) AS i FROM t"""
        for kind, pattern in kinds.items()
    )
    return f"""{name}_found AS ({found}),
{name} AS (SELECT doc_id, t, kind, m, b - length(m) AS a, b FROM (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS b FROM {name}_found))"""


def words(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def by_kind(values: dict[str, str]) -> str:
    return "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"


def listed(where: str, order: str) -> str:
    return f"coalesce(string_agg(kind || ':' || a::BIGINT || ':' || b::BIGINT, ',' ORDER BY {order}) FILTER ({where}), '')"


def counts(kinds) -> str:
    return ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in kinds)


EITHER = {c: f"[{c.upper()}{c}]" for c in "abcdefghijklmnopqrstuvwxyz"}
NAMES = "|".join("".join(EITHER.get(c, c) for c in name) + end for name, end in [("password", ""), ("passwd", ""), ("secret", ""), ("token", ""), ("api", "_?" + "".join(EITHER[c] for c in "key"))])
ASSIGN = f"(?:{NAMES})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"

PII_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b",
}
DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
#: Digits from the last one on; every second one doubled, its digits added.
LUHN = f"list_sum(list_transform(string_split(reverse({DIGITS}), ''), lambda d, i: CASE WHEN i % 2 = 1 THEN d::INT ELSE 2 * d::INT // 10 + 2 * d::INT % 10 END)) % 10 = 0"
SQUEEZED = "replace(m, ' ', '')"
COUNTRY = "map {" + ", ".join(f"'{c}': {n}" for c, n in pii.IBAN_LENGTHS.items()) + "}[m[:2]]"
TURNED = f"string_split({SQUEEZED}[5:{COUNTRY}] || {SQUEEZED}[:4], '')"
MOD97 = f"list_reduce(list_prepend(0, list_transform({TURNED}, lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c::INT ELSE ascii(c) - 55 END)), lambda x, v: (x * (CASE WHEN v < 10 THEN 10 ELSE 100 END) + v) % 97) = 1"
PII_CHECKS = {
    "email": "true",
    "ip": "list_max(list_transform(string_split(m, '.'), lambda p: coalesce(try_cast(p AS HUGEINT), 256))) <= 255",
    "card": f"length({DIGITS}) BETWEEN 16 AND 19 AND {LUHN}",
    "phone": f"length({DIGITS}) BETWEEN 8 AND 15",
    "iban": f"coalesce(length({SQUEEZED}) >= {COUNTRY} AND {MOD97}, false)",
}
NEAR = f"regexp_extract_all(lower(substr(t, greatest(a - {pii.NEAR}, 0)::BIGINT + 1, least(a, {pii.NEAR})::BIGINT) || ' ' || substr(t, b::BIGINT + 1, {pii.NEAR})), '[a-z]+')"
WEIGHT = f"""round(least(1.0, greatest(0.0, {by_kind({k: f"{v}::DOUBLE" for k, v in pii.PRIOR.items()})}
+ {pii.RAISE}::DOUBLE * list_has_any(near, {by_kind({k: words(v) for k, v in pii.CONTEXT.items()})})::INT - {pii.LOWER}::DOUBLE * list_has_any(near, {words(pii.EXAMPLE_WORDS)})::INT)), 4)"""
PII_ORDER = f"list_position({words(pii.KINDS)}, kind), a"

OP5 = f"""WITH {TEXT}, {spans("raw", PII_PATTERNS)},
ok AS (SELECT doc_id, t, kind, a, CASE kind WHEN 'iban' THEN a + length(regexp_extract(m, '^(?: ?[A-Z0-9]){{' || coalesce({COUNTRY}, 1) || '}}')) ELSE b END AS b FROM raw
WHERE {by_kind(PII_CHECKS)}),
s AS (SELECT doc_id, kind, a, b, {WEIGHT} AS score FROM (SELECT *, {NEAR} AS near FROM ok))
SELECT t.doc_id, {counts(pii.BASE_KINDS)}, sha256({listed("kind <> 'iban'", PII_ORDER)}) AS base_sha256, {listed("kind IS NOT NULL", PII_ORDER)} AS spans,
count(*) FILTER (kind = 'iban') AS n_iban, max(score) AS best_score FROM t LEFT JOIN s USING (doc_id) GROUP BY t.doc_id"""

BASE_CHECKS = {"assign": f"length(regexp_extract(m, $re$^{ASSIGN}$re$, 1)) >= 6", "access": "length(m) >= 20", "hex": "length(m) >= 24"}
#: What a whole run has to be made of and to hold, by class.
RUNS = {
    "hex": ("^[0-9A-Fa-f]+$", "[0-9]", "[A-Fa-f]"),
    "base64": ("[0-9]", "[A-Z]", "[a-z]"),
    "upper": ("^[A-Z0-9]+$", "[0-9]", "[A-Z]"),
    "lower": ("^[a-z0-9]+$", "[0-9]", "[a-z]"),
    "letters": ("^[A-Za-z]{24,}$", "[a-z]", "^.[A-Za-z]*[A-Z]"),
}
WINDOWS = "list_transform(range(0, length(m) - least(length(m), w) + 1), lambda i: list_histogram(string_split(substr(m, i + 1, least(length(m), w)), '')))"
BITS = f"list_max(list_transform({WINDOWS}, lambda h: log2(least(length(m), w)) - list_sum(list_transform(map_values(h), lambda c: c * log2(c))) / least(length(m), w)))"
CANDIDATES = " UNION ALL ".join(f"SELECT *, {window} AS w, {least} AS least FROM runs WHERE " + " AND ".join(f"regexp_matches(m, '{p}')" for p in RUNS[name]) for name, _, _, window, least in secrets.CLASSES)
EXCUSED = " OR ".join(f"regexp_matches(m, $re${p}$re$)" for p in secrets.ALLOW)
SECRET_ORDER = f"a, list_position({words((*secrets.BASE_KINDS, 'entropy'))}, kind)"

OP9 = f"""WITH {TEXT}, {spans("raw", {"assign": ASSIGN, "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"})}, {spans("runs", {"entropy": "[A-Za-z0-9+/_-]{20,}"})},
base AS (SELECT doc_id, kind, a, b FROM raw WHERE {by_kind(BASE_CHECKS)}),
random AS (SELECT DISTINCT doc_id, kind, a, b FROM ({CANDIDATES}) WHERE NOT ({EXCUSED}) AND {BITS} >= least - 1e-9),
s AS (FROM base UNION ALL FROM random WHERE NOT EXISTS (FROM base WHERE base.doc_id = random.doc_id AND base.a < random.b AND random.a < base.b))
SELECT t.doc_id, {counts(secrets.BASE_KINDS)}, sha256({listed("kind <> 'entropy'", SECRET_ORDER)}) AS base_sha256, {listed("kind IS NOT NULL", SECRET_ORDER)} AS spans,
count(*) FILTER (kind = 'entropy') AS n_entropy FROM t LEFT JOIN s USING (doc_id) GROUP BY t.doc_id"""

OP7 = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS low FROM documents UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.doc_id WHERE r.low < e.b)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(low) AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY d.doc_id"""

#: Equal sets of words are one row; similar ones share a word among the rarest that a set may have alone, and one more.
OP10 = f"""WITH l AS (SELECT doc_id, unnest(string_split(lower(text), chr(10))) AS line, generate_subscripts(string_split(lower(text), chr(10)), 1) - 1 AS no FROM documents),
w AS (SELECT doc_id, no, list_sort(list_distinct(list_filter(string_split_regex(line, '[ \\t\\x0B\\f\\r]+'), lambda x: x <> ''))) AS w FROM l),
s AS (SELECT w, min({{'doc_id': doc_id, 'no': no}}) AS first, len(w) AS n, row_number() OVER () AS id FROM w WHERE len(w) > 0 GROUP BY w),
x AS (SELECT id, unnest(w) AS x FROM s),
f AS (SELECT x, count(*) AS f FROM x GROUP BY x),
p AS (SELECT id, x, row_number() OVER (PARTITION BY id ORDER BY f, x) AS i FROM x JOIN f USING (x)),
k AS (SELECT p.id, x, first, n FROM p JOIN s USING (id) WHERE i <= n - ceil({line_dedup.SIMILAR} * n - 1e-9) + 1),
c AS (SELECT DISTINCT a.id AS a, b.id AS b FROM k a JOIN k b ON a.x = b.x AND a.first < b.first AND least(a.n, b.n) >= {line_dedup.SIMILAR} * greatest(a.n, b.n) - 1e-9),
m AS (SELECT b AS id, min(sa.first) AS first FROM (SELECT c.*, len(list_intersect(sa.w, sb.w)) AS common FROM c JOIN s sa ON sa.id = a JOIN s sb ON sb.id = b) q JOIN s sa ON sa.id = a JOIN s sb ON sb.id = b
WHERE common >= {line_dedup.SIMILAR} * (sa.n + sb.n - common) - 1e-9 GROUP BY b),
gone AS (SELECT w.doc_id, w.no FROM w JOIN s USING (w) LEFT JOIN m USING (id) WHERE coalesce(m.first, s.first) < {{'doc_id': w.doc_id, 'no': w.no}})
SELECT d.doc_id, len(string_split(text, chr(10))) AS n_lines, count(no) AS n_removed, coalesce(string_agg(no::VARCHAR, ',' ORDER BY no), '') AS removed_lines
FROM documents d LEFT JOIN gone USING (doc_id) GROUP BY d.doc_id, text"""

ORACLE_SQL = {"op5_pii": OP5, "op7_ngram_join": OP7, "op9_secrets": OP9, "op10_line_dedup": OP10}


def json_fields(fields: dict[str, str], tail: str = "") -> str:
    """SQL of a JSON object of those fields that are not null, written as text."""
    return "'{' || array_to_string(list_filter([" + ", ".join(f"""'"{k}":' || {v}""" for k, v in fields.items()) + "], lambda x: x IS NOT NULL), ',') || '}'" + tail


#: op4: turns are numbered by conversation; a call's level is half its turn if all calls that it needs, at every second turn before it, are there.
TOOL_CALLS = f"""WITH u AS (SELECT conv_id, turn, 'call-' || turn AS call_id, text, list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS words FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, 'call-' || (turn - 1) AS call_id, turn, text FROM conversations WHERE role = 'assistant'),
nodes AS (SELECT DISTINCT conv_id, turn, call_id FROM u WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
reached AS (SELECT *, CASE WHEN turn < 2 THEN 0 WHEN count(*) FILTER (turn >= 0) OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) = turn // 2 + 1 THEN turn // 2 END AS level FROM nodes),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY level, turn, call_id) AS place FROM reached WHERE level IS NOT NULL),
answers AS (SELECT conv_id, call_id, min(turn) AS result_turn, count(*) AS results, arg_min(coalesce(text, ''), (turn, text IS NOT NULL, text)) AS said, count(*) = count(text) AS told FROM a WHERE conv_id IS NOT NULL AND call_id IS NOT NULL GROUP BY ALL),
uses AS (SELECT conv_id, call_id, count(*) > 1 AS repeated FROM u GROUP BY ALL),
linked AS (SELECT u.conv_id, u.call_id, u.turn, result_turn, coalesce(results, 0) AS results, coalesce(repeated, false) AS repeated, level, place,
CASE WHEN told THEN said END AS content,
{json_fields({"about": "to_json(array_to_string(coalesce(words, [])[:5], ' '))", "chars": "length(text)", "first": "to_json(words[1])", "words": "len(words)"})} AS arguments,
array_to_string(list_concat(CASE WHEN text IS NULL THEN ['chars: missing'] ELSE [] END, CASE WHEN words[1] IS NULL THEN ['first: missing'] ELSE [] END, CASE WHEN text IS NULL THEN ['words: missing'] ELSE [] END,
CASE WHEN u.conv_id IS NULL OR u.call_id IS NULL THEN ['call: no id'] ELSE [] END), '; ') AS faults, 'reply' AS tool
FROM u LEFT JOIN answers USING (conv_id, call_id) LEFT JOIN uses USING (conv_id, call_id) LEFT JOIN placed USING (conv_id, call_id)),
lost AS (SELECT a.conv_id, a.call_id, NULL::BIGINT AS turn, a.turn AS result_turn, 1 AS results, false AS repeated, NULL::BIGINT AS level, NULL::BIGINT AS place, text AS content, 'null' AS arguments,
CASE WHEN conv_id IS NULL OR call_id IS NULL THEN 'result: no id' ELSE 'result: no call' END AS faults, NULL AS tool FROM a ANTI JOIN nodes USING (conv_id, call_id)),
rows AS (FROM linked UNION ALL BY NAME FROM lost)
SELECT conv_id, call_id, turn, result_turn, results::BIGINT AS results, repeated, level::INTEGER AS level, place::INTEGER AS place, faults,
{json_fields({"answer": json_fields({"text": "to_json(content)", "tool": "to_json(tool)"}), "arguments": "arguments", "call": json_fields({"call_id": "to_json(call_id)"})})} AS record FROM rows"""
