"""Secrets: known shapes, and strings whose characters are spread too evenly for prose.

Candidate strings are runs of one character class. A window slides over each;
its Shannon entropy is kept up by the counts of the character that enters and
the one that leaves. Strings above their class's threshold that no allow-list
pattern excuses are reported, beside the spans of three known shapes.

All of it is Spark expressions in one map over the rows: no shuffle, no Python.
Positions come from splitting a text at a pattern: the lengths of the pieces
and of the matches add up to where each match begins.

Defined cases: a null or empty text has an empty span list; repeated rows give
repeated results; other columns pass through; an empty table gives an empty
table. Positions are code points, the end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# Runs are maximal, so asking for the least length in the pattern drops just the short ones.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BASE_KINDS = ("assign", "access", "hex")

#: Character classes: name, alphabet, pattern of candidates, window, least bits a character within some window.
HEX_DIGITS = "0123456789abcdefABCDEF"
LETTERS_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
AROUND = ("(?<![A-Za-z0-9+/_-])", "(?![A-Za-z0-9+/_-])")
CLASSES = (
    ("hex", HEX_DIGITS, AROUND[0] + "(?=[A-Fa-f]*+[0-9])(?=[0-9]*+[A-Fa-f])[0-9A-Fa-f]{20,}" + AROUND[1], 16, 3.0),
    ("base64", LETTERS_DIGITS, AROUND[0] + "(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])[A-Za-z0-9+/_-]{20,}", 20, 3.7),
    ("upper", LETTERS_DIGITS, AROUND[0] + "(?=[A-Z]*+[0-9])(?=[0-9]*+[A-Z])[A-Z0-9]{20,}" + AROUND[1], 20, 3.6),
    ("lower", LETTERS_DIGITS, AROUND[0] + "(?=[a-z]*+[0-9])(?=[0-9]*+[a-z])[a-z0-9]{20,}" + AROUND[1], 20, 3.6),
    ("letters", LETTERS_DIGITS, AROUND[0] + "(?=[A-Z]*+[a-z])(?=[A-Z]?+[a-z]*+[A-Z])[A-Za-z]{24,}" + AROUND[1], 24, 3.9),
)
#: What a text has to have for any class.
LEAST_RUN = "[A-Za-z0-9+/_-]{20}"
#: Strings that look random but are no secrets: identifiers, made-up examples, paths.
ALLOW = (r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$", r"(?i)example|sample|dummy|placeholder", r"^(/[a-z_]+)+$")
BLOCK = 256


def starts(pieces: Column, matches: Column) -> Column:
    """Where each match begins (0-based): running sums, taken in blocks so that many matches stay affordable."""
    steps = F.transform(matches, lambda m, i: F.length(F.element_at(pieces, i + 1)) + F.when(i > 0, F.length(F.element_at(matches, F.greatest(i, F.lit(1))))).otherwise(0))
    count = F.size(matches)
    plus = lambda acc, x: acc + x
    total = lambda xs: F.aggregate(xs, F.lit(0), plus)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((count - 1) / BLOCK).cast("int")), lambda b: total(F.slice(steps, b * BLOCK + 1, F.lit(BLOCK))))
    before = F.aggregate(
        blocks,
        F.struct(F.array().cast("array<int>").alias("sums"), F.lit(0).alias("at")),
        lambda acc, x: F.struct(F.concat(acc["sums"], F.array(acc["at"])).alias("sums"), (acc["at"] + x).alias("at")),
        lambda acc: acc["sums"],
    )
    within = lambda i, sums: F.element_at(sums, F.floor(i / BLOCK).cast("int") + 1) + total(F.slice(steps, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK + 1))
    # `before` is bound once, as the single item of an array.
    spread = F.flatten(F.transform(F.array(before), lambda sums: F.transform(F.sequence(F.lit(0), count - 1), lambda i: within(i, sums))))
    return F.when(count > 0, spread).otherwise(F.array().cast("array<int>"))


def entropy(text: Column, window: int, alphabet: str = LETTERS_DIGITS) -> Column:
    """The largest entropy, in bits a character, among the windows of `text`; of the whole where that is shorter.

    With w characters and counts c, it is log2(w) - sum(c * log2(c)) / w. The state holds a count for each character of the
    alphabet (others share one), packed into longs of equal fields, and the sum. A step changes two counts, of the character
    that enters and of the one that leaves, and the sum by their terms: its work does not depend on the window.
    """
    bits = window.bit_length()
    fields = 63 // bits
    wide = lambda places: F.least(F.size(places), F.lit(window))
    term = lambda c: F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))
    held = lambda counts, p: F.call_function("shiftright", F.get(counts, F.floor(p / fields).cast("int")), p % fields * bits).bitwiseAND(2**bits - 1).cast("int")
    one = lambda p, j: F.when(F.floor(p / fields).cast("int") == j, F.call_function("shiftleft", F.lit(1).cast("long"), p % fields * bits)).otherwise(F.lit(0).cast("long"))
    empty = F.array(*[F.lit(0).cast("long") for _ in range(len(alphabet) // fields + 1)])
    zero = F.struct(empty.alias("counts"), F.lit(0.0).alias("terms"), F.lit(1e9).alias("least"))

    def step(places: Column, acc: Column, i: Column) -> Column:
        come, go = F.get(places, i), F.get(places, i - window)
        n_in, n_out = held(acc["counts"], come), held(acc["counts"], go)
        entered = acc["terms"] + term(n_in + 1) - term(n_in)
        terms = F.when(i < window, entered).when(come == go, acc["terms"]).otherwise(entered + term(n_out - 1) - term(n_out))
        counts = F.transform(acc["counts"], lambda c, j: c + one(come, j) - F.when(i < window, F.lit(0).cast("long")).otherwise(one(go, j)))
        return F.struct(counts.alias("counts"), terms.alias("terms"), F.when(i + 1 >= wide(places), F.least(acc["least"], terms)).otherwise(acc["least"]).alias("least"))

    end = lambda places, acc: F.log2(wide(places).cast("double")) - acc["least"] / wide(places)
    slid = lambda places: F.aggregate(F.sequence(F.lit(0), F.size(places) - 1), zero, lambda acc, i: step(places, acc, i), lambda acc: end(places, acc))
    # The places of the characters are bound once, as the single item of an array.
    return F.get(F.transform(F.array(F.transform(F.split(text, ""), lambda c: F.instr(F.lit(alphabet), c))), slid), F.lit(0))


def located(text: Column, pattern: str, first: Column | None = None) -> tuple[Column, Column]:
    """Pieces and matches of a pattern; texts without a match cost one search, and none where `first` is false."""
    hit = text.rlike(pattern) if first is None else first & text.rlike(pattern)
    none = F.array().cast("array<string>")
    return F.when(hit, F.split(text, pattern, -1)).otherwise(none), F.when(hit, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)


def spans_of(kind: str, pieces: Column, matches: Column, bits=None) -> Column:
    """array<struct<kind,start,end,text,bits>> of all matches."""
    return F.transform(
        F.arrays_zip(starts(pieces, matches).alias("s"), matches.alias("m")),
        lambda z: F.struct(F.lit(kind).alias("kind"), z["s"].alias("start"), (z["s"] + F.length(z["m"])).alias("end"), z["m"].alias("text"), (bits(z["m"]) if bits else F.lit(None).cast("double")).alias("bits")),
    )


def find_secrets(docs: DataFrame, text: str = "text", out: str = "secrets", allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """`docs` with a column `out`: array<struct<kind,start,end,text,bits>>, by start and then kind as listed.

    Kinds are assign, access, hex and entropy. The allow-list excuses entropy spans only, and one that overlaps
    a span of a known shape is left out. A column named `out` is replaced; working columns never meet others.
    """
    work = "__secrets_"
    while any(c.lower().startswith(work) for c in docs.columns):
        work = "_" + work
    source = F.coalesce(F.col(text), F.lit(""))
    kinds = [("assign", ASSIGN, None, None), ("access", ACCESS, None, None), ("hex", HEX, None, None)]
    kinds += [(f"entropy_{name}", pattern, alphabet, (window, least)) for name, alphabet, pattern, window, least in CLASSES]
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() != out.lower()]
    run, whole = f"{work}run", f"{work}text"
    held = docs.select(*kept, source.alias(whole), source.rlike(LEAST_RUN).alias(run))
    first = lambda alphabet: F.col(run) if alphabet else None
    cut = {f"{work}{k}_{part}": col for k, pattern, alphabet, _ in kinds for part, col in zip("pm", located(F.col(whole), pattern, first(alphabet)), strict=True)}
    parts = held.select(*kept, *[c.alias(n) for n, c in cut.items()])

    def found(kind, pattern, alphabet, limits):
        pieces, matches = F.col(f"{work}{kind}_p"), F.col(f"{work}{kind}_m")
        if not alphabet:
            spans = spans_of(kind, pieces, matches)
            value = lambda s: F.length(F.regexp_extract(s["text"], f"^{ASSIGN}", 1)) >= 6
            return F.filter(spans, value) if kind == "assign" else spans
        spans = spans_of("entropy", pieces, matches, lambda m: entropy(m, limits[0], alphabet))
        excused = lambda s: [s["text"].rlike(p) for p in allow]
        return F.filter(spans, lambda s: (s["bits"] >= limits[1]) & ~any_of(excused(s)))

    listed = parts.select(*kept, *[found(*k).alias(f"{work}{k[0]}") for k in kinds])
    base = F.concat(*[F.col(f"{work}{k}") for k in BASE_KINDS])
    apart = lambda s: ~F.exists(F.col(f"{work}base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    joined = listed.select(*kept, base.alias(f"{work}base"), F.concat(*[F.col(f"{work}{k[0]}") for k in kinds[3:]]).alias(f"{work}more"))
    rank = lambda s: F.array_position(F.array(*map(F.lit, (*BASE_KINDS, "entropy"))), s["kind"]).cast("int")
    order = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(rank(a) - rank(b))
    # A string of several classes is one span, with the most bits of these.
    less = lambda s: F.exists(F.col(f"{work}more"), lambda o: (o["start"] == s["start"]) & (o["bits"] > s["bits"]))
    more = F.array_distinct(F.filter(F.col(f"{work}more"), lambda s: apart(s) & ~less(s)))
    return joined.select(*kept, F.array_sort(F.concat(F.col(f"{work}base"), more), order).alias(out))


def any_of(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out
