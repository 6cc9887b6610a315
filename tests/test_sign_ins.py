"""The stream of sessions against a replay, also after a restart."""

import random
from datetime import datetime, timedelta

import duckdb

from folioworks.plans import lifecycle_queries
from folioworks.streaming import sign_ins
from folioworks.streaming.sessions import run_available

START = datetime(2024, 1, 1)
EVENTS = "account string, token string, at timestamp, seq int, event string"


def replayed(events, until):
    held, out = {}, set()
    clock = lambda s: min((s[0] + timedelta(hours=8), "expired"), (s[1] + timedelta(minutes=30), "idle"))
    for account, token, at, _, event in sorted(events, key=lambda e: (e[2], e[3])):
        mine = [k for k in held if k[0] == account and (event == "end-all" or k[1] == token)]
        if event == "start" and not mine and (account, token) not in held:
            held[account, token] = (at, at)
        for k in mine:
            if at < clock(held[k])[0]:
                if event == "touch":
                    held[k] = (held[k][0], at)
                elif event in ("end", "end-all"):
                    out.add((*k, held.pop(k)[0], at, "signed-out" if event == "end" else "ended-all"))
    return out | {(*k, s[0], *clock(s)) for k, s in held.items() if clock(s)[0] <= until}


def test_a_restarted_stream_equals_a_replay(spark, tmp_path):
    rng = random.Random(9)
    events, used, seq = [], set(), 0
    for account in ["a", "b", "c", "d"]:
        at = START
        for _ in range(rng.choice([60, 400])):
            at += timedelta(minutes=rng.choice([1, 5, 12, 29, 31]), seconds=rng.randrange(60))
            event = rng.choices(["start", "touch", "end", "end-all"], [2, 6, 1, 0.4])[0]
            token = None if event == "end-all" else f"{account}{seq // 6 - rng.randrange(2)}"
            events.append((account, token, at, seq, "touch" if event == "start" and token in used else event))
            used.add(token if event == "start" else None)
            seq += 1
    events += [("y", "y", START + timedelta(minutes=20 * i), 10_000 + i, "touch" if i else "start") for i in range(30)]
    last = max(e[2] for e in events) + timedelta(hours=3)
    events.append(("z", "z", last, seq, "start"))
    sign_ins.with_state_store(spark)
    ordered = sorted(events, key=lambda e: e[2])
    source = str(tmp_path / "in")
    for cut in (ordered[: len(ordered) // 3], ordered[len(ordered) // 3 :]):
        spark.createDataFrame(cut, EVENTS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(EVENTS).parquet(source)
        run_available(sign_ins.session_ends(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = replayed(events, last - timedelta(hours=1))
    assert got == want and {r[-1] for r in want} == {"signed-out", "ended-all", "idle", "expired"}


def test_fractions_of_milliseconds_and_the_edge_of_the_watermark_equal_the_sql(spark, tmp_path):
    """Times round to milliseconds, so two events may swap; a session that is due when the watermark comes has ended."""
    at = lambda minute, micros: START + timedelta(minutes=minute, microseconds=micros)
    rows = [
        (1, at(0, 999_600), 1, "view"), (2, at(10, 999_500), 1, "click"), (3, at(0, 900), 2, "purchase"), (4, at(0, 600), 2, "view"), (5, at(0, 1_499), 3, "view"), (6, at(0, 1_500), 3, "purchase"),
        (7, at(30, 0), 4, "view"), (8, at(30, 1_000), 5, "view"), (9, at(29, 59_999_499), 6, "view"), (10, at(120, 0), 7, "view"),
    ]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = lifecycle_queries.session_ends(spark, str(tmp_path))
    want = duckdb.sql(lifecycle_queries.ORACLE_SQL["session_ends"].replace("FROM events", f"FROM read_parquet('{tmp_path}/events.parquet/*.parquet')"))
    want = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    order = lambda rows: sorted(rows, key=lambda r: r["token"])
    assert order([r.asDict() for r in got.collect()]) == order(want) and {r["account"] for r in want} == {"1", "2", "3", "4", "6"}
