"""Personal data: patterns propose, checksums confirm, context words score.

Each kind has a pattern that proposes spans and a check that confirms them:
Luhn for card numbers, mod-97 for IBANs, value or digit counts for the rest.
The words around a confirmed span raise or lower its score; they never remove
it. The work is a map over documents: no shuffle, so no key can be hot.
Scanning is linear in the text, also for texts of one huge word or number.

Defined cases: a null or empty text has an empty span list; repeated rows give
repeated results; other columns pass through untouched; an empty table gives an
empty table.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban")

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
# A match cannot begin inside a run of digits: it would have begun at the run's
# first digit. The look-behind states that and keeps long runs linear.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")

# Lengths of IBANs by country code.
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22,
    "GR": 27, "HU": 28, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24,
}

# Words that make a span likelier, by kind, and words of made-up examples.
CONTEXT = {
    "email": ("mail", "contact", "write", "reply"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "credit", "payment", "expires"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer"),
}
EXAMPLE_WORDS = ("example", "sample", "dummy", "version", "test")
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9}
NEAR = 40  # code points on either side that count as context
RAISE, LOWER = 0.1, 0.3

SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(int(d) for d in digits[-1::-2])) % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def only_digits(found: str) -> str:
    return re.sub("[^0-9]", "", found)


def emails(text: str):
    """An address is found by its @: the run before it, cut at the last match, and the domain after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        if (domain := DOMAIN.match(text, at + 1)) and (start := run_start(text, done, at)) < at:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def run_start(text: str, low: int, at: int) -> int:
    """Where the run of local-part characters that ends before `at` begins, not below `low`."""
    size = 64
    while True:
        begin = max(low, at - size)
        start = at - len(NOT_LOCAL.split(text[begin:at])[-1])
        if start > begin or begin == low:
            return start
        size *= 4


def ibans(text: str):
    """The pattern may run on into following capitals; the country's length decides where it ends."""
    for m in IBAN.finditer(text):
        want = IBAN_LENGTHS.get(m.group()[:2])
        squeezed = m.group().replace(" ", "")
        if want and len(squeezed) >= want and mod97(squeezed[:want]):
            end, seen = m.start(), 0
            while seen < want:
                seen += text[end] != " "
                end += 1
            yield m.start(), end


def confirmed(text: str) -> list[tuple[str, int, int]]:
    """All spans, by kind as listed and then by start."""
    out = [("email", *span) for span in emails(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(small_part(p) for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(d := only_digits(m.group())) <= 19 and luhn(d)]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(only_digits(m.group())) <= 15]
    return out + [("iban", *span) for span in ibans(text)]


def small_part(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def score(text: str, kind: str, start: int, end: int) -> float:
    near = re.findall("[a-z]+", (text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]).lower())
    value = PRIOR[kind] + RAISE * any(w in CONTEXT[kind] for w in near) - LOWER * any(w in EXAMPLE_WORDS for w in near)
    return round(min(1.0, max(0.0, value)), 4)


def pii_spans(text: Column) -> Column:
    """The confirmed spans of a text, as `SPANS`: code points, end exclusive."""

    @F.arrow_udf(SPANS)
    def found(texts: pa.Array) -> pa.Array:
        rows = []
        for value in texts:
            t = value.as_py() or ""
            rows.append([{"kind": k, "start": a, "end": b, "score": score(t, k, a, b)} for k, a, b in confirmed(t)])
        return pa.array(rows, SPAN_TYPE)

    return found(text)


def find_pii(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """`docs` with a column `out` of `SPANS`; a column of that name is replaced."""
    return docs.withColumn(out, pii_spans(F.col(text)))


def mask_pii(docs: DataFrame, text: str = "text", spans: str = "pii", least: float = 0.5) -> DataFrame:
    """Replace each span that scores `least` or more by its kind in angle brackets; of overlapping ones the first counts."""
    wanted = F.array_sort(F.filter(F.col(spans), lambda s: s["score"] >= least), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    empty = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))
    source = F.coalesce(F.col(text), F.lit(""))
    folded = F.aggregate(
        wanted,
        empty,
        lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(
            F.struct(F.concat(acc["done"], F.substring(source, acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), s["kind"], F.lit(">")).alias("done"), s["end"].alias("at"))
        ),
        lambda acc: F.concat(acc["done"], F.substring(source, acc["at"] + 1, F.length(source) - acc["at"])),
    )
    return docs.withColumn(text, F.when(F.col(text).isNotNull(), folded))


def digest(kinds: tuple[str, ...], spans: Column) -> Column:
    """kind:start:end of the spans of `kinds`, in their order, joined by commas."""
    kept = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(kind: str, spans: Column) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
