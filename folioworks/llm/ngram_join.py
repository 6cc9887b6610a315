"""Exact Jaccard self-join of documents' n-gram sets, by pigeonhole on a partitioned universe.

A document's set holds hashes of its distinct word n-grams. Sets of sizes a and b
with similarity t differ in at most h(a, b) = (a + b)(1 - t) / (1 + t) elements.
Sizes fall into bands. In the lowest, a pair differs in one element at most, so
the whole set and its one-deletion neighbourhood are the signatures. In a higher
band the universe is hashed into segments. A document has a signature for each
segment that holds any of its elements, and indexes a subset: h + 1 of them, for
the largest partner it can have. At most h segments hold a difference, so if all
documents take their segments by one order, a similar pair meets in the first
that they share. The order is by cost: signatures of n-grams that are frequent
in the corpus come last, as counted in a fixed number of hash buckets. A set near
its band's upper end is entered in the next band also, for larger partners.

Where some set of a band has too few segments with elements for the argument,
the band gets a segment for each element.

Sets that are equal are one set from the start. A candidate pair is first held
against a bound from parity bitmaps: of b bits, each tells whether an odd number
of elements hash to it, so two sets differ in at least as many elements as their
bitmaps differ in bits. Pairs within the bound are verified on whole sets, in
rounds: first each document with one partner, of the two ends of the signatures
that it has, the one that it meets most often; what this links needs no more
checks among itself, so that a large group of near copies takes work in
proportion to its size. Then pairs from different groups are verified: all that
meet in signatures that few documents have; of documents that meet in one that
many have, those that agree in a part of a second, coarser partition, into one
part more than they can have differences, which documents that only share a
passage do not.

Defined cases: null text, empty text or text without words has an empty set and
links with nothing; with fewer words than n the whole sequence is the one
element; rows of equal id must have equal text; null ids are dropped; very long
texts are read whole; ties go to the smaller id; an empty table has no rows.
"""

from __future__ import annotations

import hashlib
import math
import operator
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioworks.llm.rows import with_own_ids
from folioworks.tables import stored, unused_name

WORDS = 5
PERCENT = 75
BUCKETS = 1 << 20
CHUNK = 4096
#: Up to so many ids are sent to every executor (16 MB); more are joined by a shuffle.
SEND_IDS = 2_000_000
#: Rounds in which a document is held against one partner before all remaining pairs are.
ROUNDS = 3
TINY = 5  # largest size of band 0
RATIO = 2  # of the bounds of the others
#: Signatures with more documents are those of a crowd.
MANY = 32
#: So many parts of a set, the first, travel with each of its parts, so that two sets meet in the first that they share.
HEAD = 16
#: Documents that the counts allow a signature to have in one window; more are dealt to several.
DEALT = 4096

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
IS_SPACE = np.zeros(256, dtype=bool)
SPACES = (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")
IS_SPACE[[ord(s) for s in SPACES]] = True
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes that are hashed at once. The tables of powers are this long and travel with every function that hashes words.
PART = 1 << 14


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the finaliser of MurmurHash3)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


POWERS = np.cumprod(np.full(PART, BASE, dtype=np.uint64))
INVERSE = pow(int(BASE), -1, 1 << 64)
INVERSES = np.cumprod(np.full(PART, INVERSE, dtype=np.uint64))


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash of each word: the polynomial of its bytes, from prefix sums, taken in parts that end between words.

    Words of half a part or more are hashed by themselves.
    """
    out, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + PART - 1)
        if end < len(raw):
            space = max(raw.rfind(s, at, end) for s in SPACES)
            if space <= at:
                end = next((i for i in range(end, len(raw)) if IS_SPACE[raw[i]]), len(raw))
                out.append(mixed(np.array([hash_long(raw[at:end].strip(b"".join(SPACES)))], dtype=np.uint64)))
                at = end
                continue
            end = space
        b = np.frombuffer(raw, dtype=np.uint8, count=end - at, offset=at)
        inside = np.concatenate(([False], ~IS_SPACE[b], [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * POWERS[: len(b)])))
        found = (sums[ends] - sums[starts]) * INVERSES[starts] + (ends - starts).astype(np.uint64)
        for i in np.flatnonzero(ends - starts >= PART // 2):
            found[i] = hash_long(raw[at + starts[i] : at + ends[i]])
        out.append(mixed(found))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def hash_long(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's word n-grams."""
    hashes = word_hashes((text or "").encode("utf-8", "replace").translate(LOWER))
    n = len(hashes)
    if not n:
        return hashes
    width = min(words, n)
    total = np.full(n - width + 1, np.uint64(width))
    for i in range(width):
        total = mixed(total * BASE + hashes[i : n - width + 1 + i])
    return np.unique(total)


def band_of(size: int) -> int:
    return 0 if size <= TINY else 1 + int(np.searchsorted(bounds(), size, side="right")) - 1


def bounds() -> np.ndarray:
    """Lower bounds of bands 1, 2, ..."""
    return (TINY + 1) * RATIO ** np.arange(0, 16, dtype=np.int64)


def most_apart(size: int, percent: int = PERCENT) -> int:
    """In how many elements a set can differ from a similar one, the larger of which it may be partner to."""
    return (size + size * 100 // percent) * (100 - percent) // (100 + percent)


def bands_for(size: int, percent: int = PERCENT) -> list[int]:
    """Its own band, and the next if a partner can be there."""
    own = band_of(size)
    return [own] + ([own + 1] if size * 100 // percent >= bounds()[own] else [])


def segments(band: int, single: frozenset) -> int:
    """How many segments the universe has in a band; 0 for one for each element.

    Half as many as its largest sets have elements, with room for chance: a segment then holds two elements or so, which
    documents that only share a passage seldom have in common.
    """
    most = int(bounds()[band])
    return 0 if band in single else most // 2 + 2 * math.isqrt(most)


def signatures(items: np.ndarray, band: int, weights: np.ndarray, single: frozenset, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """The signatures that a set indexes in a band, in the common order, and how frequent each can be."""
    salt = np.uint64((band + 1) * int(BASE) % (1 << 64))
    if band == 0:
        whole = mixed(items.sum(keepdims=True) + salt + np.uint64(len(items)))
        if len(items) > 1:
            whole = np.concatenate((whole, mixed(items.sum(keepdims=True) - items + salt + np.uint64(len(items) - 1))))
        return whole, np.full(len(whole), weights[(items >> np.uint64(44)).astype(np.int64)].min(), np.uint8)
    count = segments(band, single)
    where = items % np.uint64(count) if count else items
    order = np.argsort(where, kind="stable")
    where, items = where[order], items[order]
    first = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
    found = mixed(np.add.reduceat(items, first) ^ mixed(where[first] + salt))
    cost = np.minimum.reduceat(weights[(items >> np.uint64(44)).astype(np.int64)], first)
    ranked = np.lexsort((found, cost))[: most_apart(len(items), percent) + 1]
    return found[ranked], cost[ranked]


def enough(items: np.ndarray, band: int, percent: int = PERCENT) -> bool:
    """Whether a set has elements in enough segments of a band."""
    return band == 0 or len(np.unique(items % np.uint64(segments(band, frozenset())))) > most_apart(len(items), percent)


def parts_of(items: np.ndarray, percent: int = PERCENT) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the parts of a set in a coarse partition, and which of them are empty ones: for its band of sizes and for the next.

    Bands grow with the largest ratio of similar sets, so two such have a band in common. A difference spoils one part at
    most, so a set with more parts that have elements than it can have differences to any similar set of the band agrees with
    that in one of them; there are an eighth more parts than differences, which makes that so but for few sets. Only the empty parts
    of those few are listed: they are needed where both sets are such.
    """
    ratio = 100 / percent
    own = int(math.log(len(items)) / math.log(ratio) + 1e-9)
    out = []
    for band in (own, own + 1):
        most = math.ceil(ratio ** (band + 1)) + 1
        count = (2 * most * (100 - percent) // (100 + percent)) * 9 // 8 + 2
        where = (items >> np.uint64(20)) % np.uint64(count)
        sums, sizes = np.zeros(count, np.uint64), np.bincount(where.astype(np.int64), minlength=count).astype(np.uint64)
        np.add.at(sums, where.astype(np.int64), mixed(items))
        hashes = mixed(mixed(sums + np.uint64(band)) ^ mixed(np.arange(count, dtype=np.uint64) * BASE + sizes))
        largest = min(most, len(items) * 100 // percent)
        listed = sizes > 0
        if listed.sum() <= (len(items) + largest) * (100 - percent) // (100 + percent):
            listed[:] = True
        out.append((hashes[listed], sizes[listed] == 0))
    return out


def bitmap(items: np.ndarray) -> bytes:
    """Parity of the elements of each bit; twice as many bits as elements at least, a power of two."""
    bits = 1 << max(6, int(2 * len(items) - 1).bit_length())
    return np.packbits(np.bincount((items & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def least_apart(x: bytes, y: bytes) -> int:
    """In how many elements sets of these bitmaps differ at least; the longer bitmap is folded."""
    a, b = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    folded = np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)
    return int(np.bitwise_count(a ^ folded).sum())


def sketch(bits: bytes) -> list[int]:
    """A bitmap folded to 64 bits, and to 256 and 1,024 where it has as many, as whole numbers."""
    words = np.frombuffer(bits, np.int64)
    return [int(w) for width in (1, 4, 16) if len(words) >= width for w in np.bitwise_xor.reduce(words.reshape(-1, width), axis=0)]


def with_sketches(crowd: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """`crowd` (doc, n, group) with `sketch`."""

    @F.arrow_udf("array<bigint>")
    def folded(bits: pa.Array) -> pa.Array:
        return pa.array([sketch(b.as_py()) for b in bits], pa.list_(pa.int64()))

    return crowd.join(bitmaps.select("doc", folded("bits").alias("sketch")).dropDuplicates(["doc"]), "doc")


def sketches_fit(percent: int) -> Column:
    """Whether the sketches of x and y allow so few differences as similar sets of their sizes have; within the join, so that what doesn't fit is never a row."""
    most = (F.col("n_x") + F.col("n_y")) * (100 - percent) / (100 + percent)
    apart = lambda low, high: reduce(operator.add, [F.bit_count(F.get("sketch_x", F.lit(i)).bitwiseXOR(F.get("sketch_y", F.lit(i)))) for i in range(low, high)])
    fits = apart(0, 1) <= most
    for low, high, least in ((1, 5, 64), (5, 21, 256)):  # of sets with more elements, bitmaps are as wide
        fits = fits & ((F.least("n_x", "n_y") <= least) | (apart(low, high) <= most))
    return fits


def summaries(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Kind 0: for each document its size, two hashes of its set, the bands where it lacks segments, and its bitmap.
    Kind 1: for each task the counts of n-grams by hash bucket, in chunks."""
    names = ["kind", "id", "n", "one", "two", "poor", "data"]

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, dtype=np.uint32)
        signed = lambda x: int(x) - (int(x) >> 63 << 64)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                items = shingles(text.as_py(), words)
                n = len(items)
                np.add.at(counts, (items >> np.uint64(44)).astype(np.int64), 1)
                poor = sum(1 << b for b in bands_for(n, percent) if not enough(items, b, percent)) if n else 0
                rows.append((0, doc.as_py(), n, signed(items.sum()), signed(mixed(items ^ BASE).sum()), poor, bitmap(items)))
            yield record(rows)
        if counts.any():
            yield record([(1, at // CHUNK, 0, 0, 0, 0, counts[at : at + CHUNK].tobytes()) for at in range(0, BUCKETS, CHUNK)])

    def record(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "data" else pa.int64()) for n, c in zip(names, columns, strict=True)], names)

    return docs.mapInArrow(told, "kind long, id long, n long, one long, two long, poor long, data binary")


def bucket_costs(told: DataFrame) -> tuple[np.ndarray, float]:
    """For each bucket, how far its count is above a base, in quarters of a doubling; that base. What is gathered has a fixed size."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(data, np.uint32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["id", "data"])

    counts = np.zeros(BUCKETS)
    for r in told.where("kind = 1").select("id", "data").repartition(16, "id").mapInArrow(summed, "id long, data binary").collect():
        counts[r["id"] * CHUNK : (r["id"] + 1) * CHUNK] = np.frombuffer(r["data"], np.int64)
    base = max(counts.mean(), 4)
    return np.floor(4 * np.log2(np.maximum(counts / base, 1))).astype(np.uint8), base


def filtered_by_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of documents with ids (column doc); they are sent to the executors while they are few enough."""
    ids = ids.select(F.col("doc").alias("id")).distinct()
    return docs.join(F.broadcast(ids) if ids.count() <= SEND_IDS else ids, "id", how)


def sets_of(docs: DataFrame, words: int) -> DataFrame:
    """doc, items: the sorted hashes as bytes."""

    @F.arrow_udf("binary")
    def packed(texts: pa.Array) -> pa.Array:
        return pa.array([shingles(t.as_py(), words).tobytes() for t in texts], pa.binary())

    return docs.select(F.col("id").alias("doc"), packed("text").alias("items"))


def similar_pairs(docs: DataFrame, bitmaps: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those pairs (a, b) of which the sets are similar. `bitmaps`: doc, n, bits."""

    @F.arrow_udf("boolean")
    def near(n: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
        united = zip(n.to_pylist(), x.to_pylist(), y.to_pylist(), strict=True)
        return pa.array([least_apart(p, q) * (100 + percent) <= both * (100 - percent) for both, p, q in united], pa.bool_())

    @F.arrow_udf("boolean")
    def linked(of_a: pa.Array, of_b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(of_a, of_b, strict=True):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * common >= percent * (len(x) + len(y) - common) and common > 0)
        return pa.array(out, pa.bool_())

    side = lambda table, name, *columns: table.select(F.col("doc").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns])
    close = pairs.join(side(bitmaps, "a", "n", "bits"), "a").join(side(bitmaps, "b", "n", "bits"), "b")
    close = stored(close.where(near(F.col("n_a") + F.col("n_b"), "bits_a", "bits_b")).select("a", "b"), "close")
    ids = close.select(F.col("a").alias("doc")).union(close.select(F.col("b").alias("doc")))
    sets = stored(sets_of(filtered_by_ids(docs, ids, "left_semi"), words), "sets")
    both = close.join(side(sets, "a", "items"), "a").join(side(sets, "b", "items"), "b")
    return both.where(linked("items_a", "items_b")).select("a", "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """doc, component (its smallest doc) of all ends of links (a, b).

    Each node points to its smallest neighbour, pointers are followed twice, the graph is contracted, until no link is left.
    """
    edges = stored(links.where("a <> b").select("a", "b").union(links.where("a <> b").select("b", "a")).distinct(), "edges")
    nodes = stored(edges.select(F.col("a").alias("doc")).distinct().withColumn("component", F.col("doc")), "nodes")
    while edges.head(1):
        parent = edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("up"))
        parent = stored(parent, "parents")
        for _ in range(2):
            above = parent.select(F.col("a").alias("up"), F.col("up").alias("top"))
            parent = parent.join(above, "up", "left").select("a", F.coalesce("top", "up").alias("up"))
        parent = stored(parent, "parents")
        nodes = stored(nodes.join(parent.withColumnRenamed("a", "component"), "component", "left").select("doc", F.coalesce("up", "component").alias("component")), "nodes")
        left = edges.join(parent.withColumnRenamed("up", "x"), "a").join(parent.select(F.col("a").alias("b"), F.col("up").alias("y")), "b")
        edges = stored(left.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
    return nodes


def may_match(a: str, b: str, percent: int) -> Column:
    """Length and position filter of two rows that share a signature."""
    na, nb, ia, ib = F.col(f"{a}.n"), F.col(f"{b}.n"), F.col(f"{a}.at"), F.col(f"{b}.at")
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (F.greatest(ia, ib) * (100 + percent) <= (na + nb) * (100 - percent))


def index_rows(docs: DataFrame, weights: np.ndarray, base: float, single: frozenset, words: int, percent: int) -> DataFrame:
    """sig, doc, size_at, salt: the signatures that each document indexes, with its size and the signature's place in one number.

    salt is 0 but for signatures that the counts allow more than `DEALT` documents: it deals these out, by number from 1.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deals = np.ceil(base * 2.0 ** ((np.arange(256) + 1) / 4) / DEALT).astype(np.int64)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                sigs, ids, places, salts = [], [], [], []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    items = shingles(text.as_py(), words)
                    spread = int(mixed(np.array([doc & (1 << 64) - 1], np.uint64))[0] >> np.uint64(16))
                    for band in bands_for(len(items), percent) if len(items) else ():
                        found, cost = signatures(items, band, weights, single, percent)
                        n = deals[cost]
                        sigs.append(found)
                        ids.append(np.full(len(found), doc, np.int64))
                        salts.append(np.where(n > 1, 1 + spread % n, 0).astype(np.int32))
                        places.append((len(items) << 32) + (0 if band == 0 else 1) * np.arange(len(found), dtype=np.int64))
                if sigs:
                    columns = [np.concatenate(sigs).view(np.int64), np.concatenate(ids), np.concatenate(places), np.concatenate(salts)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["sig", "doc", "size_at", "salt"])

    return docs.mapInArrow(made, "sig long, doc long, size_at long, salt int")


def part_rows(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """part, doc, empty, next, head: the parts of each document's set in the coarse partition; whether of the next band; the first of that band that are not empty."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                found = [(doc, parts_of(items, percent)) for doc, text in zip(part.column(0).to_pylist(), part.column(1), strict=True) if len(items := shingles(text.as_py(), words))]
                if found:
                    bands = [(doc, later, *band) for doc, both in found for later, band in enumerate(both)]
                    hashes, empty = (np.concatenate([b[i] for b in bands]) for i in (2, 3))
                    ids = np.concatenate([np.full(len(x), doc, np.int64) for doc, _, x, _ in bands])
                    later = np.concatenate([np.full(len(x), later, bool) for _, later, x, _ in bands])
                    heads = [(len(x), x[~bare][:HEAD]) for _, _, x, bare in bands]
                    ends = np.cumsum(np.concatenate(([0], *[np.full(n, len(h)) for n, h in heads])))
                    head = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.tile(h, n) for n, h in heads]).view(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(ids), pa.array(empty), pa.array(later), head], ["part", "doc", "empty", "next", "head"])

    return docs.mapInArrow(made, "part long, doc long, empty boolean, next boolean, head array<bigint>")


def crowd_pairs(parts: DataFrame, percent: int) -> DataFrame:
    """a, b: sets (part, doc, n, group, sketch, next, head) of different groups that agree in a part and that sizes and sketches allow to be similar.

    Sets that agree in many parts are a row at the first of their heads in which they agree, or at each part if there they agree in none.
    Two of the same own band meet in that band only, where they agree if they are similar.
    """
    left, right = (parts.select("part", *[F.col(c).alias(f"{c}_{side}") for c in ("doc", "n", "group", "sketch", "next", "head")]) for side in "xy")
    apart = (F.col("doc_x") < F.col("doc_y")) & (F.col("group_x") != F.col("group_y")) & ~(F.col("next_x") & F.col("next_y"))
    sized = F.least("n_x", "n_y") * 100 >= F.greatest("n_x", "n_y") * percent
    first = F.coalesce(F.get(F.array_intersect("head_x", "head_y"), F.lit(0)), F.col("part")) == F.col("part")
    met = left.join(right, "part").where(apart & sized & sketches_fit(percent) & first)
    return met.select(F.col("doc_x").alias("a"), F.col("doc_y").alias("b"))


def link_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc, n_shingles, component of every document; documents are linked if 100 * common >= percent * united n-grams."""
    docs = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).where("id is not null")
    told = stored(summaries(docs, words, percent), "summaries")
    sizes = told.where("kind = 0").select(F.col("id").alias("doc"), "n", "one", "two", "poor").distinct()
    bitmaps = told.where("kind = 0").select(F.col("id").alias("doc"), "n", F.col("data").alias("bits"))
    weights, base = bucket_costs(told)
    poor = sizes.agg(F.bit_or("poor")).first()[0] or 0
    single = frozenset(b for b in range(64) if poor >> b & 1)

    # Equal sets count as their smallest document.
    first = sizes.where("n > 0").groupBy("n", "one", "two").agg(F.min("doc").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    copies = stored(sizes.join(first, ["n", "one", "two"]).where("doc <> first").select("doc", "first"), "copies")
    alone = filtered_by_ids(docs, copies, "left_anti")

    # Rows with company in their window; those of signatures that are dealt to several windows all go on.
    rows = index_rows(alone, weights, base, single, words, percent)
    order = Window.partitionBy("sig", "salt").orderBy("doc")
    met = rows.select("*", F.lag("doc").over(order).alias("last"), F.lead("doc").over(order).alias("next")).where("salt > 0 or last is not null or next is not null")
    me = F.struct("doc", F.shiftright("size_at", 32).cast("int").alias("n"), F.col("size_at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("at"))
    shared = stored(met.select("sig", me.alias("me")), "shared")

    links, tried, groups = None, None, None
    for _ in range(ROUNDS):
        rows = in_groups(shared, groups)
        own = F.struct("group", "me.n", "me.doc", "me.at")
        ends = rows.groupBy("sig").agg(F.min(own).alias("low"), F.max(own).alias("high")).where("low.group <> high.group")
        near = rows.join(ends, "sig").select("me", "group", F.explode(F.array("low", "high")).alias("it")).where("it.group <> group").where(may_match("me", "it", percent))
        meet = near.groupBy(F.col("me.doc").alias("doc"), F.col("it.doc").alias("other")).count()
        if tried is not None:
            meet = meet.join(tried.select(F.col("a").alias("doc"), F.col("b").alias("other")), ["doc", "other"], "left_anti")
        best = meet.groupBy("doc").agg(F.max_by("other", F.struct("count", -F.col("other"))).alias("other"))
        pairs = stored(best.select(F.col("doc").alias("a"), F.col("other").alias("b")), "pairs")
        new = stored(similar_pairs(docs, bitmaps, pairs, words, percent), "links")
        links, tried = (new, pairs) if links is None else (links.union(new), tried.union(pairs))
        groups = stored(components(links), "groups")

    rows = in_groups(shared, groups)
    spread = rows.groupBy("sig").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.count("*").alias("docs")).where("low <> high").select("sig", "docs")
    rows = stored(rows.join(spread, "sig"), "open")
    few = rows.where(F.col("docs") <= MANY)
    left = few.select("sig", F.col("me").alias("x"), F.col("group").alias("x_group"))
    right = few.select("sig", F.col("me").alias("y"), F.col("group").alias("y_group"))
    pairs = left.join(right, "sig").where(F.col("x.doc") < F.col("y.doc")).where("x_group <> y_group").where(may_match("x", "y", percent))
    pairs = pairs.select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b"))
    crowd = stored(rows.where(F.col("docs") > MANY).select(F.col("me.doc").alias("doc"), F.col("me.n").alias("n"), "group").distinct(), "crowd")
    crowd = stored(with_sketches(crowd, bitmaps), "sketched")
    # Sets that agree in nothing but an empty part have a signature of the crowd in common: they meet there, by part and signature.
    parts = stored(part_rows(filtered_by_ids(docs, crowd, "left_semi"), words, percent), "all-parts")
    marks = rows.where(F.col("docs") > MANY).select(F.col("me.doc").alias("doc"), "sig").distinct()
    bare = parts.where("empty").join(marks, "doc").select(F.xxhash64("part", "sig").alias("part"), "doc", "next", "head")
    parts = stored(parts.where("not empty").select("part", "doc", "next", "head").union(bare).join(crowd, "doc"), "parts")
    pairs = pairs.union(crowd_pairs(parts, percent)).distinct()
    links = links.union(similar_pairs(docs, bitmaps, stored(pairs, "pairs"), words, percent))

    groups = components(links)
    home = sizes.select("doc", "n").join(copies, "doc", "left").withColumn("first", F.coalesce("first", "doc"))
    home = home.join(groups.withColumnRenamed("doc", "first"), "first", "left")
    return home.select("doc", F.col("n").alias("n_shingles"), F.coalesce("component", "first").alias("component"))


def in_groups(shared: DataFrame, groups: DataFrame | None) -> DataFrame:
    """Rows of shared signatures with the group that each document is in so far: sig, me, group."""
    if groups is None:
        return shared.select("sig", "me", F.col("me.doc").alias("group"))
    out = shared.withColumn("doc", F.col("me.doc")).join(groups, "doc", "left")
    return out.select("sig", "me", F.coalesce("component", "doc").alias("group"))


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """`docs` without those that are linked, over any number of links, to one of smaller id; columns as they were.

    Rows that share an id are told apart by their texts; of whole copies one stays.
    """
    rows, own = with_own_ids(docs, key, text)
    linked = link_documents(rows, text, own, words, percent)
    doc = unused_name("doc", rows.columns)
    gone = linked.where("doc <> component").select(F.col("doc").alias(doc))
    left = rows.join(gone, F.col(f"`{own}`") == F.col(doc), "left_anti")
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])
