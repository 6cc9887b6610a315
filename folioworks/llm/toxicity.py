"""Toxicity by compression distance.

Two zstandard dictionaries are made from labelled texts. The ordinary one is
trained on ordinary texts. The toxic one holds, before the same ordinary
content, the words that toxic texts have far more often, by counts of documents.
A window is a word, in a carrier of ordinary text that either dictionary holds
whole; it is compressed with both, and what the toxic one saves tells how near
the word is to what only toxic texts have. The ordinary dictionary is filled up
at its front to the same length, so that both place the shared content alike and
differ by nothing else. Savings over a text's windows (mean, largest, shares and
counts above thresholds), for several dictionary sizes, are calibrated to a
probability by a logistic regression. A bounded cache keeps the savings of words
met before.

Training reads a bounded sample (`per_class` labelled rows of each class, by a
hash of their ids); two thirds make the dictionaries, one calibrates.
Scoring is a map over whole texts, with memory for one batch.

Defined cases: null and empty texts score as a text without savings; very long
texts are read whole; repeated rows score alike; a table of labels with one
class or none gives that class's share (0 without any) for every text; other
columns pass through, those named score or predicted are replaced; an empty
table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks.tables import stored

#: Bytes of the words that toxic texts have, bytes of the carrier.
SETTINGS = ((2048, 48), (4096, 24))
LEAST_SAVED = (2, 3, 4, 5, 6, 7)
CACHED = 250_000  # words
SHARED = 12_000  # bytes of ordinary content
THRESHOLD = 0.7


@dataclass
class Model:
    ordinary: bytes
    words: list[bytes]
    middle: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    bias: float


def pieces_of(text: bytes, size: int) -> list[bytes]:
    """Runs of whole words of at least `size` bytes, the last may be shorter: what the ordinary dictionary is trained on."""
    out, held, n = [], [], 0
    for word in text.split():
        held.append(word)
        n += len(word) + 1
        if n >= size:
            out.append(b" " + b" ".join(held) + b" ")
            held, n = [], 0
    if held:
        out.append(b" " + b" ".join(held) + b" ")
    return out


class Comparer:
    """What the toxic dictionaries save on the words of a text."""

    def __init__(self, ordinary: bytes, words: list[bytes]):
        self.pairs, self.known = [], {}
        for room, carrier in SETTINGS:
            special = b""
            for word in words:  # the commonest last, nearest to the text
                if len(special) + len(word) + 1 <= room:
                    special = b" " + word + special
            special = b"\x01" * (-len(special) % 24) + special
            filler = bytes((7 * i * i + i) % 31 for i in range(len(special)))
            self.pairs.append((ordinary[-carrier:] + b" ", compressor(filler + ordinary).compress, compressor(special + ordinary).compress))

    def saved(self, word: bytes) -> tuple[int, ...]:
        out = self.known.get(word)
        if out is None:
            if len(self.known) >= CACHED:
                self.known.clear()
            out = tuple(len(plain(w := carrier + word + b" ")) - len(toxic(w)) for carrier, plain, toxic in self.pairs)
            self.known[word] = out
        return out

    def features(self, text: str) -> np.ndarray:
        words = text.lower().encode("utf-8", "replace").split()
        saved = np.array([self.saved(w) for w in words] or [(0,) * len(self.pairs)])
        top = -np.sort(-saved, axis=0)
        parts = [saved.mean(axis=0), top[0], top[:2].mean(axis=0), top[:4].mean(axis=0)]
        for least in LEAST_SAVED:
            over = saved >= least
            parts += [over.mean(axis=0), np.sqrt(over.sum(axis=0))]
        return np.concatenate([*parts, [np.log1p(len(words))]])


def compressor(content: bytes) -> zstd.ZstdCompressor:
    settings = zstd.ZstdCompressionParameters.from_level(3, write_checksum=0, write_content_size=0, write_dict_id=0, format=zstd.FORMAT_ZSTD1_MAGICLESS)
    held = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=settings)
    return zstd.ZstdCompressor(dict_data=held, compression_params=settings)


def sampled(labels: DataFrame, per_class: int) -> DataFrame:
    """doc_id, label, hash, third: about `per_class` labelled ids of each class, by a hash of the id; `third` deals them in three."""
    counts = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    hashed = F.pmod(F.xxhash64(F.lit("toxicity"), F.col("doc_id").cast("string")), F.lit(1 << 30))
    out = labels.select("doc_id", F.col("toxic").cast("int").alias("label"), hashed.alias("hash"), (hashed % 3).alias("third"))
    share = F.lit(0.0)
    for k, n in counts.items():
        share = F.when(F.col("label") == k, min(1.0, per_class / n)).otherwise(share)
    return out.where(F.col("hash") < share * (1 << 30)).orderBy("hash", "doc_id").limit(3 * per_class)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 3000, least_ratio: float = 8.0, least_evidence: float = 20.0, most_words: int = 2000, most_pieces: int = 40_000) -> Model:
    """Learn from documents (doc_id, text) and labels (doc_id, toxic). Ids are sampled first; only their texts are read.

    `per_class` bounds the labelled rows of a class. Two more bounds hold what the driver gathers: of words that qualify, the
    `most_words` that most toxic documents have (a dictionary holds 4,096 bytes of them, so more would be cut off), and
    `most_pieces` pieces of ordinary text, chosen by hash, for the one dictionary of `SHARED` bytes.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = stored(known, "labels")
    chosen = F.broadcast(stored(sampled(known, per_class), "label-sample"))  # 3 * per_class rows at most
    sample = stored(docs.where("text is not null").select("doc_id", "text").join(chosen, "doc_id"), "labelled")
    classes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(classes) < 2:
        n = len(Comparer(b"", []).features(""))
        only = next(iter(classes), 0)
        return Model(b"", [], np.zeros(n), np.ones(n), np.zeros(n), 20.0 if only else -20.0)

    # Words of the toxic class: counts of documents, combined before the shuffle.
    first = sample.where("third < 2")
    sizes = {r["label"]: r["count"] for r in first.groupBy("label").count().collect()}
    words = first.select("label", F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+"))).alias("word")).where(F.length("word").between(3, 32))
    counts = words.groupBy("word").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("plain"))
    toxic, plain = max(1, sizes.get(1, 0)), max(1, sizes.get(0, 0))
    ratio = (F.col("toxic") / toxic) / ((F.col("plain") + 0.5) / plain)
    # Twice the log-likelihood ratio of the two shares against one common share.
    both = (F.col("toxic") + F.col("plain")) / (toxic + plain)
    gain = lambda n, share: F.when(n > 0, n * F.log(n / share)).otherwise(0.0)
    evidence = 2 * (gain(F.col("toxic"), toxic * both) + gain(F.col("plain"), plain * both))
    told = counts.where((ratio >= least_ratio) & (evidence >= least_evidence)).orderBy(F.desc("toxic"), "word").limit(most_words).collect()

    @F.arrow_udf("array<binary>")
    def cut(texts: pa.Array) -> pa.Array:
        return pa.array([pieces_of(t.as_py().lower().encode("utf-8", "replace"), 64) for t in texts], pa.list_(pa.binary()))

    pieces = first.where("label = 0").select(F.explode_outer(cut("text")).alias("w"))
    pieces = [bytes(r["w"]) for r in pieces.orderBy(F.xxhash64("w"), "w").limit(most_pieces).collect()]
    try:
        trained = zstd.train_dictionary(SHARED + 4096, pieces, k=64, d=6).as_bytes()
    except zstd.ZstdError:  # too little text to train on
        trained = b"".join(pieces)
    ordinary, special = trained[-SHARED:], [r["word"].encode() for r in told]

    held = {"model": (ordinary, special)}

    @F.arrow_udf("array<double>")
    def measured(texts: pa.Array) -> pa.Array:
        comparer = Comparer(*held["model"])
        return pa.array([comparer.features(t.as_py()).tolist() for t in texts], pa.list_(pa.float64()))

    rows = sample.where("third = 2").select("label", measured("text").alias("x")).collect()
    x, y = np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows], float)
    middle, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    # The sample has too many toxic rows; weights bring their share back to the labels' own.
    share = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    each = np.where(y == 1, share.get(1, 1) / max(1, (y == 1).sum()), share.get(0, 1) / max(1, (y == 0).sum()))
    weights, bias = logistic((x - middle) / spread, y, each / each.mean())
    return Model(ordinary, special, middle, spread, weights, bias)


def logistic(x: np.ndarray, y: np.ndarray, each: np.ndarray, decay: float = 1e-3, steps: int = 40) -> tuple[np.ndarray, float]:
    """Weighted logistic regression by Newton's method."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        slope = a.T @ (each * (y - p)) / len(x) - decay * w
        curve = (a * (each * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a / len(x) + decay * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def toxic_score(model: Model, text: Column) -> Column:
    """The probability, between 0 and 1, that a text is toxic."""

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        comparer, out = Comparer(model.ordinary, model.words), []
        for t in texts:
            x = (comparer.features(t.as_py() or "") - model.middle) / model.spread
            out.append(float(1 / (1 + np.exp(-np.clip(x @ model.weights + model.bias, -30, 30)))))
        return pa.array(out, pa.float64())

    return scored(text)


def score_documents(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with score and predicted (1 from `threshold` on)."""
    out = docs.withColumn("score", toxic_score(model, F.col(f"`{text}`")))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
