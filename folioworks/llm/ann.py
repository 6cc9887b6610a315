"""Nearest neighbours by multi-index hashing.

Vectors get binary codes: the signs of a learned rotation (iterative
quantisation, one rotation for every 64 bits). A code is split into substrings
and each substring is indexed. Codes within Hamming distance r agree with the
query, in one substring of m at least, but for r // m bits: probing each index
at that radius retrieves every code within r (pigeonhole). Codes beyond r are
left out, the others ranked by their true distance.

Rotations and r are learned on a bounded sample (`sample` vectors, chosen by a
hash of their ids): r is the distance within which the share `reach` of the
sample's true neighbours lies. The index covers all rows. Each vector is coded
once and kept with its code as bytes, of the width that it was given in. The
index is built and probed in cells of a grid, a block of rows by a block of as
many queries, which copies least for what a task holds; blocks grow with the
root of the table up to `most` vectors and are dealt by a hash of the id, so no
cell is large. Each cell returns its k best for a query; where fewer than k
codes of a cell are within r, the radius grows until k are. A window keeps the
best of the cells' answers.

Defined cases: vectors that are null, zero, of another length than most, or hold
null or non-finite parts take no part, nor do rows without an id; of rows with
equal ids one is used; ties go to the smaller id; a table with fewer rows gives
all of them; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType
from pyspark.sql.window import Window

from folioworks.tables import stored

BITS = 256
SUBSTRING = 8


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """id and v (double): the rows that take part."""
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(fine)
    width = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    rows = rows.where(F.size("v") == (width[0]["n"] if width else 0))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def quantised(x: np.ndarray, bits: int, rounds: int = 20, seed: int = 11) -> np.ndarray:
    """Rotations that bring centred vectors near the corners of a cube; dimensions x bits."""
    rng, width = np.random.default_rng(seed), x.shape[1]
    parts = []
    for _ in range(math.ceil(bits / width)):
        turn = np.linalg.qr(rng.normal(size=(width, width)))[0]
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(np.sign(x @ turn).T @ x)
            turn = vt.T @ u.T
        parts.append(turn)
    return np.concatenate(parts, axis=1)[:, :bits]


class Codes:
    """Centre, rotations and radius."""

    def __init__(self, sample: np.ndarray, k: int, bits: int, reach: float):
        self.mean = sample.mean(axis=0)
        self.turn = quantised(sample - self.mean, bits)
        self.bits = self.turn.shape[1]
        codes = self.of(sample)
        some = np.arange(0, len(sample), max(1, len(sample) // 200))
        true = np.argsort(distances(sample[some], sample), axis=1)[:, 1 : k + 1]
        apart = np.bitwise_count(codes[some][:, None, :] ^ codes[true]).sum(axis=2)
        self.radius = int(np.quantile(apart, reach)) if apart.size else self.bits

    def of(self, x: np.ndarray) -> np.ndarray:
        """One row of bytes, the substrings, for each vector."""
        return np.packbits((x - self.mean) @ self.turn > 0, axis=1)


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((q * q).sum(1)[:, None] - 2 * q @ x.T + (x * x).sum(1)[None, :], 0))


def masks(most: int) -> np.ndarray:
    """All bytes with at most so many bits set."""
    every = np.arange(256, dtype=np.uint8)
    return every[np.bitwise_count(every) <= most]


def probe(codes: np.ndarray, asked: np.ndarray, radius: int) -> list[np.ndarray]:
    """For each asked code the rows within the radius: each substring's buckets are read, then whole codes compared."""
    m = codes.shape[1]
    flips = masks(radius // m)
    columns = np.ascontiguousarray(codes.T)
    order = np.argsort(columns, axis=1, kind="stable")
    sorted_ = np.take_along_axis(columns, order, axis=1)
    edges = np.stack([np.searchsorted(sorted_[j], np.arange(257)) for j in range(m)])
    words = codes.view(np.uint64 if m % 8 == 0 else np.uint8)
    out = []
    for code in asked:
        seen = np.zeros(len(codes), dtype=bool)
        for j in range(m):
            buckets = (code[j] ^ flips).astype(int)
            starts, sizes = edges[j, buckets], edges[j, buckets + 1] - edges[j, buckets]
            # Places of all rows of these buckets, one run after another.
            places = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            seen[order[j, places]] = True
            if seen.all():
                break
        rows = np.flatnonzero(seen)
        apart = np.bitwise_count(words[rows] ^ code.view(words.dtype)).sum(axis=1, dtype=np.int64)
        out.append(rows[apart <= radius])
    return out


def coded(rows: DataFrame, learned: Codes, width: str) -> DataFrame:
    """id, code, v of rows (id, v): codes and vectors as bytes; `width` is the numpy name of the parts' type."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                columns = [batch.column(0), *(pa.array([r.tobytes() for r in part], pa.binary()) for part in (learned.of(x), x.astype(width)))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "code", "v"])

    return rows.select("id", "v").mapInArrow(told, "id long, code binary, v binary")


def cell_search(most_apart: int, bits: int, k: int, width: str):
    """The k nearest of a cell's rows to each of its queries."""
    as_rows = lambda column, kind: np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)

    def searched(cell: pa.Table) -> pa.Table:
        cell = cell.sort_by("id")
        asks = cell["asks"].to_numpy()
        ids = cell["id"].to_numpy()
        asking, ids = ids[asks], ids[~asks]
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(asking) and len(ids):
            queries, rows = cell.filter(pa.array(asks)), cell.filter(pa.array(~asks))
            asked, codes = as_rows(queries["code"], np.uint8), as_rows(rows["code"], np.uint8)
            q, x = as_rows(queries["v"], width), as_rows(rows["v"], width)
            for query, vector, code, near in zip(asking, q, asked, probe(codes, asked, most_apart), strict=True):
                radius = most_apart
                while len(near := near[ids[near] != query]) < k and radius < bits:
                    radius = min(bits, radius + bits // 8)
                    near = probe(codes, code[None, :], radius)[0]
                gap = x[near].astype(float) - vector.astype(float)
                score = np.sqrt((gap * gap).sum(axis=1))
                best = np.lexsort((ids[near], score))[:k]
                out.append((np.full(len(best), query), ids[near][best], score[best]))
        return pa.table(dict(zip(("query_id", "vec_id", "score"), (np.concatenate(c) for c in zip(*out, strict=True)), strict=True)))

    return searched


def nearest(
    vectors: DataFrame,
    every: int,
    k: int = 10,
    key: str = "vec_id",
    vector: str = "embedding",
    bits: int = BITS,
    sample: int = 4096,
    reach: float = 0.97,
    block: int = 8,
    most: int = 1 << 18,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest other rows to each row whose id `every` divides.

    A block of rows, as one of queries, has `block` times the root of the table's size, but no more than `most`.
    """
    width = "<f4" if isinstance(vectors.schema[vector].dataType.elementType, FloatType) else "<f8"
    rows = stored(usable(vectors, key, vector), "usable")
    counts = rows.agg(F.count("*").alias("rows"), F.count_if(F.col("id") % every == 0).alias("queries")).first()
    total, queries = counts["rows"], counts["queries"]
    schema = "query_id long, vec_id long, score double"
    spark = vectors.sparkSession
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    some = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < math.ceil(sample * 1.2 / total * (1 << 30)))
    learned = Codes(np.array([r["v"] for r in some.orderBy(F.xxhash64("id"), "id").limit(sample).collect()] or [rows.first()["v"]]), k, bits, reach)

    size = min(max(1, block * math.isqrt(total)), most)
    across, down = math.ceil(total / size), max(1, math.ceil(queries / size))
    deal = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    everywhere = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    codes = stored(coded(rows, learned, width), "codes")
    held = codes.select("id", "code", "v", F.lit(False).alias("asks"), deal(across, 1).alias("across"), everywhere(down).alias("down"))
    asked = codes.where(F.col("id") % every == 0).select("id", "code", "v", F.lit(True).alias("asks"), everywhere(across).alias("across"), deal(down, 2).alias("down"))
    found = held.unionByName(asked).groupBy("across", "down").applyInArrow(cell_search(learned.radius, learned.bits, k, width), schema)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
