"""Benchmark decontamination by templates.

A text's words are canonicalised: numbers, names and units become typed
placeholders, other words lose their case and outer punctuation. Windows of
`WINDOW` canonical words are hashed and joined to the windows of the benchmark
items. Re-worded numbers and names thus still match; whether they were replaced
consistently is checked on the matches: each value of an item's slots has to
stand for one value of the document, and no two for the same. A document is
contaminated by an item if the matched windows are `SHARE` of the item's, and
the slots are consistent, or the words match literally. That is asked of each
occurrence, and one that passes is enough: of the windows at one offset between
document and item, of those at offsets near each other (a copy with words put in
or left out), and of all the pair's windows (a copy in scattered parts). However
long the item, `RUN` windows of it in a row, at one offset, are enough too, if
their slots are consistent or the words match literally.

An item of fewer words than `WINDOW` is one window of its own length, and the
documents' windows are taken at the lengths that such items have. An item without
any window of `LITERAL` plain words (or all plain, if it has fewer) is searched
literally: by its words in lower case, with marks that stand alone as words.

All of it is Spark expressions. The benchmark's hashes are counted: they are
sent to every executor while they are few; beyond that both sides are shuffled.
Windows are map-side filtered by the join before anything of the corpus moves.
Decisions are by document, item and occurrence, from sets of distinct value
pairs. A window that a document has n times and an item m times gives n * m rows.

Defined cases: null or empty texts match nothing, nor do items of marks alone;
an item of one word matches every document with that word; windows with fewer
than `LITERAL` plain words are left out of items that have others; repeated items count once, and so do repeated windows in a share; rows with a null id match
nothing and stay; other columns pass through; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioworks.tables import stored, unused_name

WINDOW = 8
LITERAL = 4
SHARE = 0.5
RUN = 6  # windows in a row: 13 words
CONSISTENT = 0.8
#: Up to so many window hashes of the benchmark are sent to every executor (about 40 MB).
SEND_WINDOWS = 1_000_000

# Units of measurement that follow a number.
UNITS = ("mm", "cm", "m", "km", "mg", "g", "kg", "t", "ml", "l", "s", "sec", "min", "h", "hours", "days", "years", "miles", "feet", "inches", "pounds", "dollars", "euros", "percent", "%", "$", "€", "usd", "eur", "degrees")
PUNCTUATION = """.,;:!?"'()[]{}<>*_~`|/\\#+=-–—¿¡«»“”„’‘…$€£%&@^"""
NUMBER, NAME, UNIT = -1, -2, -3  # keys of placeholders; those of plain words are positive


def with_words(texts: DataFrame, key: str, text: str) -> DataFrame:
    known = texts.where(F.col(key).isNotNull() & F.col(text).isNotNull())
    return known.select(key, F.split(text, r"\s+").alias("words"))


def bare(word: Column) -> Column:
    return F.btrim(word, F.lit(PUNCTUATION))


def with_keys(worded: DataFrame) -> DataFrame:
    """Adds clean, the words without outer punctuation, and keys: for each word a placeholder, or a hash of the word in lower case; 0 for punctuation alone.

    A name begins with a capital, is not all capitals and does not begin a sentence; a unit follows a number. Each step is
    a column of its own, so that no word is trimmed or lowered twice.
    """
    cleaned = worded.select("*", F.transform("words", bare).alias("clean"))
    lowered = cleaned.select("*", F.transform("clean", lambda w: F.lower(w)).alias("low"))
    before = lambda i: F.get("words", i - 1)
    after_number = lambda i: (i > 0) & F.ascii(F.get("clean", i - 1)).between(48, 57)
    inside = lambda i: (i > 0) & (before(i) != "") & ~F.right(before(i), F.lit(1)).isin(".", "!", "?", ":", ";")
    capital = lambda low, clean: (low != clean) & (F.substring(low, 1, 1) != F.substring(clean, 1, 1)) & (F.upper(clean) != clean)

    def key(low: Column, i: Column) -> Column:
        clean, first = F.get("clean", i), F.ascii(low)
        out = F.when(low == "", F.when(F.get("words", i).isin("%", "$", "€") & after_number(i), UNIT).otherwise(0))
        out = out.when(first.between(48, 57), NUMBER).when(capital(low, clean) & ~F.ascii(clean).between(97, 122) & inside(i), NAME)
        return out.when(low.isin(*UNITS) & after_number(i), UNIT).otherwise(F.shiftrightunsigned(F.xxhash64(low), 1)).cast("long")

    return lowered.select(*worded.columns, "clean", F.transform("low", key).alias("keys"))


def literals(words: Column) -> Column:
    """The key of each word with its case and outer punctuation lost; marks alone are words."""
    return F.transform(words, lambda w: F.xxhash64(F.lower(F.when(bare(w) == "", w).otherwise(bare(w)))))


def hashes(keys: Column, wide: int = WINDOW) -> Column:
    """A hash of each window of `wide` keys; none where there are fewer."""
    count = F.size(keys) - wide + 1
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.xxhash64(F.slice(keys, i, F.lit(wide))))).otherwise(F.array().cast("array<bigint>"))


def windowed(texts: DataFrame, key: str, text: str, forms: list[tuple[bool, int]]) -> DataFrame:
    """key, literal, wide, at, hash of every window of the given forms (literal, wide).

    Only these go through the explode, so that long texts stay linear.
    """
    worded = with_words(texts, key, text)
    keys = {False: F.filter("keys", lambda k: k != 0), True: literals(F.filter(F.col("words"), lambda w: w != ""))}
    used = [k for k in keys if any(k == literal for literal, _ in forms)]
    keyed = (with_keys(worded) if False in used else worded).select(key, *[keys[k].alias(f"keys_{k}") for k in used])
    if len(forms) == 1:
        # The outer form: for the inner one a filter on the array's size would be inferred and its expression repeated in it.
        literal, wide = forms[0]
        listed = keyed.select(key, F.lit(literal).alias("literal"), F.lit(wide).alias("wide"), hashes(F.col(f"keys_{literal}"), wide).alias("hashes"))
    else:
        form = lambda literal, wide: F.struct(F.lit(literal).alias("literal"), F.lit(wide).alias("wide"), hashes(F.col(f"keys_{literal}"), wide).alias("hashes"))
        listed = keyed.select(key, F.explode_outer(F.array(*[form(*f) for f in forms])).alias("f")).select(key, "f.*")
    return listed.select(key, "literal", "wide", F.posexplode_outer("hashes").alias("at", "hash")).where("hash is not null")


def with_slots(texts: DataFrame, key: str, text: str, windows: DataFrame) -> DataFrame:
    """Rows of `windows` (key, at, wide, and others) with `slots`, array<struct<place,value>>: what stood where placeholders are.

    A text's windows come to it as one list, no longer than the text.
    """
    listed = windows.groupBy(key).agg(F.collect_list(F.struct(*[c for c in windows.columns if c != key])).alias("list"))
    keyed = with_keys(with_words(texts, key, text))
    both = keyed.select(key, F.filter(F.arrays_zip("words", "keys"), lambda z: z["keys"] != 0).alias("pairs")).join(listed, key)
    placed = lambda at, wide: F.transform(F.slice("pairs", at + 1, wide), lambda z, i: F.struct(i.alias("place"), F.lower(bare(z["words"])).alias("value"), z["keys"].alias("k")))
    slots = lambda at, wide: F.transform(F.filter(placed(at, wide), lambda z: z["k"] < 0), lambda z: F.struct(z["place"].alias("place"), z["value"].alias("value")))
    out = both.select(key, F.transform("list", lambda w: F.struct(w.alias("window"), slots(w["at"], w["wide"]).alias("slots"))).alias("list"))
    return out.select(key, F.explode_outer("list").alias("x")).select(key, "x.window.*", "x.slots")


def item_windows(items: DataFrame, key: str, text: str) -> DataFrame:
    """key, literal, wide, hash, at, no, slots, windows: the windows of each item that are used, numbered, and how many differ."""
    once = items.where(F.col(key).isNotNull() & F.col(text).isNotNull()).groupBy(key).agg(F.min(text).alias(text))
    once = stored(once, "items")
    lengths = with_keys(with_words(once, key, text)).select(key, F.size(F.filter("keys", lambda k: k != 0)).alias("length"))
    short = [r["length"] for r in lengths.where(F.col("length").between(1, WINDOW - 1)).select("length").distinct().collect()]
    rows = windowed(once, key, text, [(False, wide) for wide in (*short, WINDOW)]).join(lengths, key)
    rows = with_slots(once, key, text, rows.where(F.col("wide") == F.least("length", F.lit(WINDOW))))
    used = rows.where(F.col("wide") - F.size("slots") >= F.least(F.lit(LITERAL), "wide")).drop("length")
    used = stored(used, "item-windows")
    left = once.join(used.select(key).distinct(), key, "left_anti")
    # Marks before and after the words of an item are none of it.
    marks = lambda w: F.btrim(w, F.lit(PUNCTUATION + " \t\r\n")) == ""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    ends = left.select(key, words.alias("words")).withColumn("said", F.filter(F.transform("words", lambda w, i: F.when(~marks(w), i)), lambda i: i.isNotNull())).where(F.size("said") > 0)
    plain = stored(ends.select(key, F.array_join(F.slice("words", F.array_min("said") + 1, F.array_max("said") - F.array_min("said") + 1), " ").alias(text), (F.array_max("said") - F.array_min("said") + 1).alias("length")), "items")
    wides = [r["wide"] for r in plain.select(F.least("length", F.lit(WINDOW)).alias("wide")).distinct().collect()]
    if wides:
        found = windowed(plain.select(key, text), key, text, [(True, wide) for wide in wides]).join(plain.select(key, "length"), key)
        found = found.where(F.col("wide") == F.least("length", F.lit(WINDOW))).withColumn("slots", F.array().cast(used.schema["slots"].dataType))
        used = used.unionByName(found.drop("length"))
    used = used.withColumn("no", F.row_number().over(Window.partitionBy(key).orderBy("at")))
    return used.join(used.groupBy(key).agg(F.countDistinct("hash").alias("windows")), key)


def occurrences(met: DataFrame) -> DataFrame:
    """Each row of `met` once for every occurrence that it belongs to: kind, id.

    Its columns: doc, item, at, item_at, no, and slots, item_slots, which are null or empty for windows without.
    """
    pair = Window.partitionBy("doc", "item")
    rows = met.withColumn("offset", F.col("at") - F.col("item_at"))
    rows = rows.withColumn("gap", F.col("offset") - F.lag("offset").over(pair.orderBy("offset")))
    rows = rows.withColumn("near", F.count_if(F.col("gap") > WINDOW).over(pair.orderBy("offset")))
    # Of several windows of the item that one of the document equals, a copy has the one whose offset most others share.
    rows = rows.withColumn("support", F.count("*").over(Window.partitionBy("doc", "item", "offset")))
    rows = rows.withColumn("choice", F.row_number().over(Window.partitionBy("doc", "item", "near", "at").orderBy(F.desc("support"), "offset")))
    # Runs of windows, and those of windows that match literally: their numbers grow with their place.
    same = F.coalesce(F.col("slots") == F.col("item_slots"), F.lit(True))
    rows = rows.dropDuplicates(["doc", "item", "at", "item_at", "slots"]).withColumn("same", same)
    place = lambda *more: F.col("no") - F.dense_rank().over(Window.partitionBy("doc", "item", "offset", *more).orderBy("no"))
    rows = rows.withColumn("run", place()).withColumn("true_run", F.when(F.col("same"), place("same")))
    of = lambda kind, *number: F.struct(F.lit(kind).alias("kind"), F.xxhash64(*number).alias("id"))
    kinds = F.array(of("pair", F.lit(0)), of("offset", F.col("offset")), F.when(F.col("choice") == 1, of("near", F.col("near"))), of("run", F.col("offset"), F.col("run")), F.when(F.col("same"), of("run", F.col("offset"), F.col("true_run"), F.lit("literal"))))
    return rows.select(*met.columns, F.explode(F.array_compact(kinds)).alias("o")).select(*met.columns, "o.*")


def matches(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """For each document and item with common windows: matched, windows, share, slots, consistent (share), literal, contaminated.

    The figures are those of one occurrence: one that contaminates, if there is any, else that of the largest share.
    The large table's windows meet the items' hashes in a map; what follows has the matches only.
    """
    bodies = docs.select(F.col(f"`{key}`").alias("doc"), F.col(f"`{text}`").alias("body"))
    known = item_windows(items.select(F.col(f"`{item_key}`").alias("item"), F.col(f"`{item_text}`").alias("body")), "item", "body")
    known = stored(known.withColumnsRenamed({"slots": "item_slots", "at": "item_at"}), "item-windows")
    few = known.count() <= SEND_WINDOWS
    forms = sorted((r["literal"], r["wide"]) for r in known.select("literal", "wide").distinct().collect()) or [(False, WINDOW)]
    found = windowed(bodies, "doc", "body", forms).drop("literal", "wide").join(F.broadcast(known) if few else known, "hash")
    found = stored(found.select("doc", "item", "hash", "at", "wide", "item_at", "no", "windows", "item_slots"), "windows-met")

    # What stands in the slots has to be read from the documents again, those that have any.
    open_ = found.where(F.size("item_slots") > 0).select("doc", "at", "wide").distinct()
    ids = open_.select("doc").distinct()
    some = bodies.join(F.broadcast(ids) if ids.count() <= SEND_WINDOWS else ids, "doc", "left_semi")
    filled = with_slots(some, "doc", "body", open_).dropDuplicates(["doc", "at", "wide", "slots"])
    rows = stored(occurrences(found.join(filled, ["doc", "at", "wide"], "left")), "occurrences")

    one_of = ["doc", "item", "kind", "id"]
    counted = rows.groupBy(*one_of).agg(F.countDistinct("hash").alias("matched"), F.max("windows").alias("windows"), F.countDistinct("no").alias("length"))
    pairs = rows.where("slots is not null").select(*one_of, F.explode(F.arrays_zip("item_slots", "slots")).alias("z")).select(*one_of, F.col("z.item_slots.value").alias("theirs"), F.col("z.slots.value").alias("ours")).distinct()
    # A value is consistent if it stands for one value, and that for no other.
    one = pairs.groupBy(*one_of, "theirs").agg(F.count("*").alias("stands_for"), F.min("ours").alias("ours"))
    back = pairs.groupBy(*one_of, "ours").agg(F.count("*").alias("stood_by"))
    fits = one.join(back, [*one_of, "ours"]).groupBy(*one_of).agg(
        F.count("*").alias("slots"),
        F.count_if((F.col("stands_for") == 1) & (F.col("stood_by") == 1)).alias("fitting"),
        F.count_if((F.col("theirs") == F.col("ours")) & (F.col("stands_for") == 1)).alias("same"),
    )
    n = F.coalesce("slots", F.lit(0))
    judged = counted.join(fits, one_of, "left").select(
        "doc", "item", ((F.col("kind") == "run") & (F.col("length") >= RUN)).alias("long"), "matched", "windows", (F.col("matched") / F.col("windows")).alias("share"), n.alias("slots"),
        F.when(n == 0, 1.0).otherwise(F.coalesce("fitting", F.lit(0)) / n).alias("consistent"), (n == F.coalesce("same", F.lit(0))).alias("literal"),
    )
    judged = judged.withColumn("contaminated", (F.col("long") | (F.col("share") >= SHARE)) & (F.col("literal") | (F.col("consistent") >= CONSISTENT)))
    best = F.max(F.struct("contaminated", (F.col("contaminated") & F.col("literal")).alias("sure"), "share", "consistent", "matched", "windows", "slots", "literal"))
    out = judged.groupBy("doc", "item").agg(best.alias("b"))
    return out.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), *[f"b.{c}" for c in ("matched", "windows", "share", "slots", "consistent", "literal", "contaminated")])


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without those that an item contaminates; columns as they were."""
    doc = unused_name("doc", docs.columns)
    gone = matches(docs, items, key, text).where("contaminated").select(F.col("doc_id").alias(doc)).distinct()
    return docs.join(gone, F.col(f"`{key}`") == F.col(doc), "left_anti")
