"""Queries of the operators against their SQL."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from folioworks.llm import queries, sql
from tests.llm.test_copies import near_texts
from tests.llm.test_spans import PII_TEXTS, SECRET_TEXTS

SF = "/root/testdata/sf0.001"


def held_against_sql(spark, name, sf, table="documents"):
    c = duckdb.connect()
    c.execute(f"create view {table} as select * from read_parquet('{sf}/{table}.parquet')")
    told = c.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in told.description]
    want = sorted(told.fetchall(), key=repr)
    df = queries.QUERIES[name](spark, sf)
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect()), key=repr) == want
    return [dict(zip(names, r, strict=True)) for r in want]


@pytest.mark.parametrize("name", sorted(sql.ORACLE_SQL))
def test_given_documents(spark, name):
    assert len(held_against_sql(spark, name, SF)) == 200


def odd_texts():
    """Texts with every kind of span, context words, random strings of each class, and near copies of texts and lines."""
    rng = random.Random(11)
    run = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    random_ = [run(a, n) for a in (upper + digits, lower + digits, upper + lower, upper + lower + digits + "+/", "0123456789abcdef", "0123456789ABCDEF", "ABab01") for n in (19, 20, 24, 40)]
    strings = [f"é {s}; token={s} {s}/x" for s in random_] + [" ".join(random_), "/some/path_to/anything_like/this 1.2.3." + "9" * 60]
    near = [f"{w} {s} {e}" for w in ("call", "credit card", "my bank:", "host") for s in PII_TEXTS[3:8] + PII_TEXTS[12:] for e in ("", "example")]
    lines = near_texts(4, 150, (3, 40))
    return PII_TEXTS + SECRET_TEXTS + strings + near + lines + ["\n".join(lines[i : i + 7]) for i in range(0, 150, 5)]


@pytest.mark.parametrize("name", sorted(sql.ORACLE_SQL))
def test_odd_texts(spark, name, tmp_path):
    texts = odd_texts()
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())}), tmp_path / "documents.parquet")
    rows = held_against_sql(spark, name, tmp_path.as_posix())
    assert len(rows) == len(texts)
    if name == "op5_pii":
        assert all(sum(r[f"n_{k}"] for r in rows) for k in ("email", "ip", "card", "phone", "iban")) and len({r["best_score"] for r in rows}) > 6
    if name == "op9_secrets":
        assert sum(r["n_entropy"] for r in rows) > 20


def test_tool_calls(spark, tmp_path):
    rows = held_against_sql(spark, "op4_tool_calls", "/root/testdata/sf0.01", "conversations")
    assert len(rows) > 200 and {r["level"] for r in rows} >= {0, 1}
    rng = random.Random(5)
    texts = [None, "", " \t", "one", "a b  c\nd e f g", 'quo"te \\ and \x01 \t/ é 😀', "x" * 50_000, "\x0bv\x0b w"]
    turns = [(rng.choice([0, 1, 2, 3, None]), rng.choice([*range(-2, 12), None]), rng.choice(["user", "user", "assistant", "system", None]), rng.choice(texts)) for _ in range(160)]
    turns += [(9, t, "user" if t % 2 == 0 else "assistant", "so it goes on") for t in range(40) if t != 30]
    columns = {n: pa.array(c, k) for n, k, c in zip(("conv_id", "turn", "role", "text"), (pa.int64(), pa.int64(), pa.string(), pa.string()), zip(*turns, strict=True), strict=True)}
    pq.write_table(pa.table(columns), tmp_path / "conversations.parquet")
    rows = held_against_sql(spark, "op4_tool_calls", tmp_path.as_posix(), "conversations")
    assert {"call: no id", "result: no call", "result: no id", "first: missing"} <= {r["faults"] for r in rows} and any(r["repeated"] for r in rows) and 14 in {r["level"] for r in rows}
    assert all(r["level"] is None for r in rows if r["conv_id"] == 9 and (r["turn"] or 0) > 30)
