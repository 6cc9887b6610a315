"""Row numbers of their own for documents whose ids repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioworks.scans import numbered
from folioworks.tables import stored, unused_name


def with_own_ids(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, str]:
    """`docs`, and the name of a column that tells its rows apart in the order of `key`.

    That is `key` itself while no two rows share one. Else it is a new column: the row's number by key and a hash of its text,
    null where the key is null.
    """
    ids = docs.select(F.col(f"`{key}`").alias("id")).where("id is not null")
    if not ids.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").head(1):
        return docs, key
    own, all_, turn, said = (unused_name(n, [*docs.columns, "rank", "total"]) for n in ("own_id", "all_rows", "turn", "said"))
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(said))
    inner = F.col(said)[key]
    rows = held.withColumns({all_: F.lit(0), turn: F.struct(inner.alias("id"), F.xxhash64(F.col(said)[text]).alias("hash"))})
    ranked = numbered(rows, [all_], [turn])
    kept = [F.col(said)[c].alias(c) for c in docs.columns]
    return stored(ranked.select(*kept, F.when(inner.isNotNull(), F.col("rank")).alias(own)), "own-ids"), own
