"""Line dedup by an exact set-similarity join on the words of lines.

A line's tokens are its distinct words in lower case, as 64-bit keys whose high
bits tell how frequent the word is in the corpus: sorted keys are in order of
rarity. Lines of equal sets are settled by a hash aggregate; one stands for them.

Similar sets of sizes a and b differ in at most h = (a + b)(1 - t) / (1 + t)
tokens. In order of rarity, some `RUN` common tokens therefore stand next to each
other in both sets before the differences are used up: within the first
h * (RUN - 1) + RUN tokens and the n - ceil(t * n) that a set may have alone.
The signatures of a line are the runs in that prefix (with RUN = 1 it is the
usual prefix filter). A run of three stays selective where single words, even
rather rare ones, would make candidates grow with the square of the corpus.

Lines that share a signature are candidates if their sizes and the places of the
signature leave enough overlap (length and positional filter), and 64 parity bits
of the sets differ in no more; what passes is verified on whole sets. A line goes if any earlier line (by doc_id, then line
number) is similar to it.

The lines of a signature that few have all meet. Of those that many have each is
held first against the earliest, which settles most of a large group of copies in
a pass that grows with the group, not with its square. Those still standing meet
earlier lines with which they also share a segment: tokens are dealt by hash to
more segments than sets can have differences, so similar sets agree in one whole
segment at least, while lines that only share a passage do not.

All of it is Spark expressions. Rarity comes from counts of all words in a fixed
number of hash buckets; it orders tokens and never changes the result.

Defined cases: blank lines stay and match nothing; rows whose text or id is null
pass unchanged; of rows with the same id `dedup_lines` takes each for itself, in
the order of a hash of their texts, while `later_copies` speaks of ids and so
needs them to be unique; other columns, also ones named like a working
column, pass through; very long lines have as many signatures as a share of
their words; an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks.llm.rows import with_own_ids
from folioworks.tables import stored, unused_name

#: Of words. One changed word in a line of 40 leaves 0.95 of its words.
SIMILAR = 0.9
BUCKET_BITS = 15
HASH_BITS = 57
MASK = (1 << HASH_BITS) - 1
#: Levels of frequency in a doubling; the highest level stands for 2^48 occurrences.
STEPS = 1.3
RUN = 3
#: Signatures with more lines are refined by segments.
MANY = 64
#: Up to so many ids are sent to every executor (under 100 MB); more are joined by a shuffle.
SEND_IDS = 1_000_000
SPACES = "\t\x0b\f\r"


def lines_of(docs: DataFrame) -> DataFrame:
    """doc, no, line (in lower case) of a table with doc and text."""
    lines = F.posexplode_outer(F.split(F.lower("text"), "\n")).alias("no", "line")
    return docs.where("doc is not null and text is not null").select("doc", lines)


def words_of(line: Column) -> Column:
    """Its words; white space other than single spaces is squeezed first, where there is any."""
    odd = F.contains(line, F.lit("  ")) | F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    for s in SPACES:
        odd = odd | F.contains(line, F.lit(s))
    return F.split(F.when(odd, F.trim(F.regexp_replace(line, r"[ \t\x0B\f\r]+", " "))).otherwise(line), " ")


def bucket_of(key: Column) -> Column:
    return F.shiftrightunsigned(key, 64 - BUCKET_BITS).cast("int")


def rarity(docs: DataFrame) -> Column:
    """array<int>: the level of frequency of each hash bucket of words, from all words of all lines.

    As many numbers come to the driver as there are buckets.
    """
    words = lines_of(docs).select(F.explode(F.split("line", " ")).alias("word"))
    counts = words.groupBy(bucket_of(F.xxhash64("word")).alias("bucket")).agg(F.count("*").alias("n"))
    levels = [0] * (1 << BUCKET_BITS)
    for r in counts.select("bucket", F.floor(F.log2(F.col("n") + 1) * STEPS).cast("int").alias("level")).collect():
        levels[r["bucket"]] = r["level"]
    return F.split(F.lit(",".join(map(str, levels))), ",").cast("array<int>")


def with_tokens(lines: DataFrame, levels: Column) -> DataFrame:
    """Replaces `line` by `tokens`, sorted and distinct, and `n`, their number; blank lines are left out."""
    kept = [c for c in lines.columns if c != "line"]
    words = lines.where(F.col("line").rlike(r"\S")).select(*kept, words_of(F.col("line")).alias("words"))
    key = lambda h: F.shiftleft(F.get(levels, bucket_of(h)).cast("long"), HASH_BITS).bitwiseOR(h.bitwiseAND(F.lit(MASK)))
    tokens = F.transform(F.transform("words", lambda w: F.xxhash64(w)), key)
    sets = words.select(*kept, F.sort_array(F.array_distinct(tokens)).alias("tokens"))
    return sets.select(*kept, "tokens", F.size("tokens").alias("n"))


def most_apart(a: Column, b: Column, similar: float) -> Column:
    """In how many tokens similar sets of these sizes differ at most; a hair is added for rounding."""
    return F.floor((a + b) * ((1 - similar) / (1 + similar)) + 1e-9).cast("int")


def largest_partner(n: Column, similar: float) -> Column:
    return F.floor(n / similar + 1e-9).cast("int")


def run_length(similar: float) -> int:
    """Tokens in a run: sets have at least t / (1 - t) common tokens for each difference."""
    return max(1, min(RUN, math.floor((similar / (1 - similar) + 1 + 1e-9) / 2))) if similar < 1 else RUN


def with_signatures(sets: DataFrame, similar: float) -> DataFrame:
    """Adds sigs, of which similar lines share one: the runs of the prefix, none where only equal sets are similar."""
    run, n, kept = run_length(similar), F.col("n"), sets.columns
    apart = most_apart(n, largest_partner(n, similar), similar)
    long = apart * (run - 1) + (n - F.ceil(n * similar - 1e-9)).cast("int") + 1
    sized = sets.select("*", F.when(apart > 0, F.least(long, n - (run - 1))).otherwise(0).alias("count"))
    listed = F.transform(F.sequence(F.lit(0), F.col("count") - 1), lambda i: F.xxhash64(*[F.get("tokens", i + k) for k in range(run)]))
    return sized.select(*kept, F.when(F.col("count") > 0, listed).otherwise(F.array().cast("array<bigint>")).alias("sigs"))


def parity(tokens: Column) -> Column:
    """64 bits, each telling whether an odd number of tokens hash to it: sets differ in at least as many tokens as these in bits."""
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))))


def may_match(similar: float, placed: bool = True) -> Column:
    """Length, parity and positional filter of an earlier row `a` and a later `b`: line, n, bits, at (where a signature is)."""
    na, nb = F.col("a.n"), F.col("b.n")
    apart = [F.abs(na - nb), F.bit_count(F.col("a.bits").bitwiseXOR(F.col("b.bits")))]
    if placed:
        ia, ib = F.col("a.at"), F.col("b.at")
        apart.append(F.abs(ia - ib) + F.abs((na - ia) - (nb - ib)))
    return (F.col("a.line") < F.col("b.line")) & (F.greatest(*apart) <= most_apart(na, nb, similar))


def filtered_by_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of `docs` with an id in `ids` (doc, distinct, stored); sent to the executors while their number is small enough."""
    return docs.join(F.broadcast(ids) if ids.count() <= SEND_IDS else ids, "doc", "left_semi")


def tokens_of(docs: DataFrame, lines: DataFrame, levels: Column) -> DataFrame:
    """line (struct doc, no), tokens of the given lines (column line), read from the texts again."""
    lines = stored(lines.select("line.doc", "line.no").distinct(), "lines-read")
    ids = stored(lines.select("doc").distinct(), "lines-read")
    near = lines_of(filtered_by_ids(docs, ids)).join(lines, ["doc", "no"], "left_semi")
    sets = with_tokens(near, levels).dropDuplicates(["doc", "no"])
    return stored(sets.select(F.struct("doc", "no").alias("line"), "tokens"), "line-sets")


def verified(sets: DataFrame, pairs: DataFrame, similar: float) -> DataFrame:
    """b (struct doc, no): those of the pairs (a, b) whose Jaccard similarity is at least `similar`."""
    both = pairs.join(sets.select(F.col("line").alias("a"), F.col("tokens").alias("of_a")), "a")
    both = both.join(sets.select(F.col("line").alias("b"), F.col("tokens").alias("of_b")), "b")
    common = F.size(F.array_intersect("of_a", "of_b"))
    return both.where(common >= (F.size("of_a") + F.size("of_b") - common) * similar - 1e-9).select("b").distinct()


def with_segments(rows: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """`rows` (with line), once for each segment of their sets: `segment`.

    Bands of sizes grow with 1 / t, so that the sizes of two similar sets lie in the same or in neighbouring bands; a set
    is cut for its own and for the next. Of one segment more than sets of a band can have differences, one is equal.
    """
    band = F.floor(F.log(F.size("tokens").cast("double")) / math.log(1 / similar) + 1e-9).cast("int")
    most = lambda b: F.ceil(F.pow(F.lit(1 / similar), b + 1)).cast("int")
    banded = sets.select("line", "tokens", F.explode(F.array(band, band + 1)).alias("band"))
    banded = banded.select("*", (most_apart(most(F.col("band")), most(F.col("band")), similar) + 1).alias("count"))
    dealt = lambda i: F.filter("tokens", lambda x: F.pmod(x, F.col("count").cast("long")) == i)
    cut = banded.select("line", "band", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("count") - 1), lambda i: F.xxhash64(dealt(i)))).alias("no", "hash"))
    return rows.join(cut.select("line", F.xxhash64("band", "no", "hash").alias("segment")), "line")


def later_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", similar: float = SIMILAR) -> DataFrame:
    """(doc, no): the lines that an earlier line is similar to, each once."""
    docs = docs.select(F.col(f"`{key}`").alias("doc"), F.col(f"`{text}`").alias("text"))
    levels = rarity(docs)
    sets = with_signatures(with_tokens(lines_of(docs), levels), similar)
    prints = sets.select(F.monotonically_increasing_id().alias("id"), "doc", "no", "n", F.xxhash64("tokens").alias("one"), F.xxhash64(F.lit(1), "tokens").alias("two"), parity(F.col("tokens")).alias("bits"), "sigs")
    prints = stored(prints, "line-prints")

    # Lines of the same words: all but the earliest go. The aggregate combines before it shuffles; what it finds is sent to
    # the lines while it is small, else joined in a way that adaptive execution splits where a line is very frequent.
    same = ["one", "two", "n"]
    first = prints.groupBy(*same).agg(F.min(F.struct("doc", "no")).alias("first"), F.count("*").alias("lines")).where("lines > 1").select(*same, "first")
    first = stored(first, "line-again")
    met = prints.select("doc", "no", *same).join(F.broadcast(first) if first.count() <= SEND_IDS else first, same)
    copies = stored(met.where(F.struct("doc", "no") != F.col("first")).select("doc", "no"), "line-copies")
    alone = prints.where(F.size("sigs") > 0).join(F.broadcast(copies) if copies.count() <= SEND_IDS else copies, ["doc", "no"], "left_anti")

    # The lines that stand for the rest, by the signatures that more than one of them has. Only ids meet the counts.
    rows = alone.select("id", F.posexplode("sigs").alias("at", "sig"))
    counted = rows.groupBy("sig").agg(F.count("*").alias("lines")).where("lines > 1")
    shared = rows.join(counted, "sig").join(prints.select("id", F.struct("doc", "no").alias("line"), "n", "bits"), "id")
    shared = stored(shared.select("sig", "lines", F.struct("line", "n", "at", "bits").alias("row")), "line-signatures")
    few, many = shared.where(F.col("lines") <= MANY), shared.where(F.col("lines") > MANY)
    firsts = stored(many.groupBy("sig").agg(F.min("row").alias("a")), "line-firsts")

    # Few lines meet all earlier ones; of many, each meets the earliest.
    pairs = meeting(few, few, ["sig"], similar).union(meeting(firsts.withColumnRenamed("a", "row"), many, ["sig"], similar))
    pairs = stored(pairs.distinct(), "line-pairs")
    gone = stored(verified(tokens_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("line")), levels), pairs, similar), "line-gone")

    # Those of many that are still standing meet the earlier ones that they share a segment with.
    standing = many.join(gone.select(F.col("b").alias("line")), F.col("row.line") == F.col("line"), "left_anti")
    standing = stored(standing.join(firsts, "sig").where(F.col("row.line") != F.col("a.line")).select("sig", "row"), "line-standing")
    crowd = many.join(standing.select("sig").distinct(), "sig", "left_semi").select(F.struct("row.line", "row.n", "row.bits").alias("row"), "sig")
    crowd = stored(crowd.groupBy("row").agg(F.collect_set("sig").alias("sigs")).select("row.line", "row.n", "row.bits", "sigs"), "line-crowd")
    sets = tokens_of(docs, crowd, levels)
    parts = stored(with_segments(crowd, sets, similar).select("segment", F.struct("line", "n", "bits", "sigs").alias("row")), "line-segments")
    open_ = parts.join(standing.select("row.line").distinct(), F.col("row.line") == F.col("line"), "left_semi")
    pairs = stored(meeting(parts, open_, ["segment"], similar, crowded=True).distinct().join(pairs, ["a", "b"], "left_anti"), "line-pairs")
    rest = verified(sets, pairs, similar)
    return copies.union(gone.select("b.doc", "b.no")).union(rest.select("b.doc", "b.no")).distinct()


def meeting(everyone: DataFrame, later: DataFrame, by: list[str], similar: float, crowded: bool = False) -> DataFrame:
    """a, b: each line of `later` with each earlier one that passes the filters; of a crowd they have to share a signature too."""
    a, b = everyone.select(*by, F.col("row").alias("a")), later.select(*by, F.col("row").alias("b"))
    fits = may_match(similar, placed=not crowded)
    met = a.join(b, by).where(fits & F.arrays_overlap("a.sigs", "b.sigs") if crowded else fits)
    return met.select(F.col("a.line").alias("a"), F.col("b.line").alias("b"))


def drop_lines(docs: DataFrame, lines: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """`docs` without the given lines (doc, no); columns as they were."""
    doc, gone = unused_name("doc", docs.columns), unused_name("gone", docs.columns)
    listed = lines.groupBy(F.col("doc").alias(doc)).agg(F.collect_set("no").alias(gone))
    parts = F.split(f"`{text}`", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone))
    kept = F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n")
    out = docs.join(listed, F.col(f"`{key}`") == F.col(doc), "left")
    return out.select(*[F.when(F.col(gone).isNotNull(), kept).otherwise(F.col(f"`{c}`")).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", similar: float = SIMILAR) -> DataFrame:
    """`docs` with every line gone that an earlier line is similar to. Rows that share an id are told apart by their texts."""
    rows, own = with_own_ids(docs, key, text)
    return drop_lines(rows, later_copies(rows, text, own, similar), text, own).select(*[F.col(f"`{c}`") for c in docs.columns])
