"""Language identification with error-correcting output codes.

Each language has a codeword of bits. For each bit a binary classifier over
hashed byte n-grams predicts whether the text's language has it set. Decoding
takes the codeword with the smallest loss, each bit's loss weighted by how
reliable its classifier was in training; a small lead over the second codeword
marks the prediction as ambiguous.

Training uses a bounded sample: at most `per_language` labelled documents of each
language, and fewer where that makes more than `most_rows` in all, chosen by a
hash of their ids. Only their feature vectors (16 KB each) reach the driver. Prediction is a map over whole texts.

Defined cases: null texts and texts without a letter get `und` and score 0; very
long texts are read whole; repeated rows get equal results; other columns stay,
those named like an output are replaced; with no labelled text at all every
prediction is `und`; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks.tables import unused_name

UNKNOWN = "und"
#: Up to so many languages are sent to every executor.
SEND_LANGUAGES = 100_000
DIMENSIONS = 1 << 12
# ASCII that is no letter counts as a space.
SPACED = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
RESULT = "struct<lang_pred:string,score:double,margin:double,ambiguous:boolean>"


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits, of -1 and 1
    weights: np.ndarray  # dimensions x bits
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit's loss


def features(text: str) -> np.ndarray:
    """Square roots of the counts of hashed byte n-grams (1 to 4), scaled to length 1."""
    squeezed = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(SPACED).split()) + b" "
    out = np.zeros(DIMENSIONS, dtype=np.float32)
    for at in range(0, len(squeezed), 1 << 18):  # in parts, so that a huge text needs little memory
        b = np.frombuffer(squeezed[at : at + (1 << 18) + 3], dtype=np.uint8).astype(np.uint32)
        gram = np.zeros_like(b)
        for n in range(1, 5):
            gram = gram[: len(b) - n + 1] * np.uint32(257) + b[n - 1 :] + np.uint32(1)
            slots = (gram * np.uint32(2654435761) + np.uint32(n * 40503)) * np.uint32(2246822519) >> np.uint32(20)
            out += np.bincount(slots[: 1 << 18], minlength=DIMENSIONS)
            if len(gram) < 2:
                break
    out = np.sqrt(out)
    return out / max(float(np.sqrt((out * out).sum())), 1e-9)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """All distinct splits for few languages, else random dense words; rows differ in many bits."""
    if n == 1:
        return np.ones((1, 1))
    if n <= 5:
        bits = range(1, 2 ** (n - 1))
        return np.array([[1 if k == 0 or not b >> (k - 1) & 1 else -1 for b in bits] for k in range(n)], dtype=float)
    rng, width = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    words = (rng.choice([-1.0, 1.0], size=(n, width)) for _ in range(200))
    usable = (w for w in words if all(abs(c.sum()) < n for c in w.T))
    return max(usable, key=lambda w: min((w[i] != w[j]).sum() for i in range(n) for j in range(i)))


def labelled_sample(docs: DataFrame, text: str, lang: str, key: str, per_language: int, most_rows: int) -> DataFrame:
    """About `per_language` rows of each language, `most_rows` in all, chosen by a hash of the key."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = rows.groupBy(F.col(lang).alias("lang")).count()
    each = counts.agg(F.count("*").alias("n")).first()["n"]
    if not each:
        return rows.limit(0)
    wanted = max(1, min(per_language, most_rows // each))
    share = counts.select("lang", F.least(F.lit(1.0), wanted / F.col("count")).alias("share"))
    share = F.broadcast(share) if each <= SEND_LANGUAGES else share
    spread = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 30)) / float(1 << 30)
    picked = rows.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"), spread.alias("spread")).join(share, "lang").where("spread < share")
    return picked.orderBy(F.xxhash64(F.col("key").cast("string")), "key").limit(2 * most_rows)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = 600, most_rows: int = 6000) -> Model:
    """Learn codewords' classifiers from the labelled rows of `docs`."""

    @F.arrow_udf("binary")
    def vectors(texts: pa.Array) -> pa.Array:
        return pa.array([features(t or "").tobytes() for t in texts.to_pylist()], pa.binary())

    sample = labelled_sample(docs, text, lang, key, per_language, most_rows)
    # Rows come one at a time into one buffer, so the driver holds the sample once.
    told, data = [], bytearray()
    for r in sample.select("lang", vectors(F.col("text")).alias("x")).toLocalIterator():
        told.append(r["lang"])
        data += r["x"]
    languages = sorted(set(told))
    if not languages:
        return Model([], np.zeros((0, 1)), np.zeros((DIMENSIONS, 1), np.float32), np.zeros(1, np.float32), np.ones(1))
    x = np.frombuffer(data, dtype=np.float32).reshape(len(told), DIMENSIONS)
    which = np.array([languages.index(t) for t in told])
    code = codewords(len(languages))
    y = code[which]
    weights, bias = logistic(x, y)
    right = ((x @ weights + bias) * y > 0).mean(axis=0)
    return Model(languages, code, weights, bias, np.maximum(right - 0.5, 0.01))


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 150, rate: float = 40.0, decay: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regressions for all columns of y (-1, 1) at once, by gradient descent with momentum."""
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    speed = np.zeros_like(w)
    y = y.astype(np.float32)
    for _ in range(steps):
        pull = y / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30)))
        speed = 0.9 * speed + x.T @ pull / len(x) - decay * w
        w += rate * 0.1 * speed
        b += 0.5 * pull.mean(axis=0)
    return w, b


def decode(model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of features: index of the nearest codeword, its score, its lead over the second."""
    told = x @ model.weights + model.bias
    loss = np.stack([(np.log1p(np.exp(-np.clip(told * word, -30, 30))) * model.trust).sum(axis=1) for word in model.code], axis=1) / model.trust.sum()
    near = np.exp(-4 * (loss - loss.min(axis=1, keepdims=True)))
    score = near / near.sum(axis=1, keepdims=True)
    ranked = np.sort(score, axis=1)
    best = score.argmax(axis=1)
    return best, ranked[:, -1], ranked[:, -1] - (ranked[:, -2] if score.shape[1] > 1 else 0)


def predictor(model: Model, least_margin: float):
    shape = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("margin", pa.float64()), ("ambiguous", pa.bool_())])

    @F.arrow_udf(RESULT)
    def predicted(texts: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(texts), 64):
            part = texts.slice(at, 64).to_pylist()
            known = [bool(t and model.languages and any(map(str.isalpha, t))) for t in part]
            unknown = {"lang_pred": UNKNOWN, "score": 0.0, "margin": 0.0, "ambiguous": True}
            rows = [unknown] * len(part)
            if any(known):
                best, score, margin = decode(model, np.stack([features(t) for t, k in zip(part, known, strict=True) if k]))
                told = ({"lang_pred": model.languages[b], "score": float(s), "margin": float(m), "ambiguous": bool(m < least_margin)} for b, s, m in zip(best, score, margin, strict=True))
                rows = [next(told) if k else unknown for k in known]
            out += rows
        return pa.array(out, shape)

    return predicted


def identify(docs: DataFrame, model: Model, text: str = "text", least_margin: float = 0.2) -> DataFrame:
    """`docs` with lang_pred, score (0 to 1), margin and ambiguous (margin under `least_margin`)."""
    names = ("lang_pred", "score", "margin", "ambiguous")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in names]
    told = unused_name("language", docs.columns)
    held = docs.select(*kept, predictor(model, least_margin)(F.col(f"`{text}`")).alias(told))
    return held.select(*kept, *[F.col(f"{told}.{n}").alias(n) for n in names])


def remainder(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo n; null keys count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(n))
