"""The lockout fold against a plain one, also over accounts of many blocks."""

import random
from datetime import datetime, timedelta

import duckdb
import pytest

from folioworks.operators import lockouts
from folioworks.plans import lifecycle_queries


def plain(rows):
    out, state = {}, {}
    for account, seq, at, matched in sorted(rows, key=lambda r: (r[2] if r[2] is not None else -(1 << 50), r[1])):
        count, last = state.get(account, (0, None))
        now = -(1 << 50) if at is None else at
        recent = last is not None and now - last < 900
        if count >= 5 and recent:
            out[account, seq] = "locked"
        elif matched:
            out[account, seq], state[account] = "ok", (0, None)
        else:
            out[account, seq], state[account] = "failed", (count + 1 if recent else 1, now)
    return out


@pytest.mark.parametrize("block", [8, 1024])
def test_outcomes_equal_a_plain_fold(spark, monkeypatch, block):
    monkeypatch.setattr(lockouts, "BLOCK", block)
    rng = random.Random(block)
    rows = [(a, i, rng.choice([None, *[rng.randint(0, 9000)] * 60]), rng.choice([True, False, False, False, False, False, None])) for a in [*range(25), None] for i in range(rng.randrange(1, 45))]
    # A third of all: one account under attack, a try every few seconds, whose phase is never forgotten; one that always succeeds.
    rows += [(99, i, 7 * i, i == 400) for i in range(500)] + [(98, i, i, True) for i in range(100)] + [(97, i, 5, False) for i in range(100)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "account int, seq int, at long, matched boolean")
    got = lockouts.lockouts(df)
    assert {(r.account, r.seq): r.outcome for r in got.collect()} == plain(rows)
    assert got.columns == ["account", "seq", "at", "matched", "outcome"] and lockouts.lockouts(df.where("false")).count() == 0


def test_times_are_rounded_to_seconds_as_in_the_sql(spark, tmp_path):
    """An attempt half a second before a lock has run out comes after it."""
    start, late = datetime(2024, 1, 1), 904 * 240
    rows = [(10 * u + i, start + timedelta(seconds=240 * i if i < 5 else late - early), u, "error" if i < 5 else "view") for u, early in enumerate((0.4, 0.5, 0.500001, 0.6, 0, -0.2)) for i in range(6)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = lifecycle_queries.lockout_fold(spark, str(tmp_path))
    want = duckdb.sql(lifecycle_queries.ORACLE_SQL["lockout_fold"].replace("FROM events", f"FROM read_parquet('{tmp_path}/events.parquet/*.parquet')"))
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
    assert {r.account for r in got.where("outcome = 'ok'").collect()} == {0, 1, 4, 5}
