"""Sessions over a stream of sign-in events, with state by account and timers for both clocks.

events: account, token, at, seq, event: start opens a session under a token that was never used, touch is a request that carries it, end signs it
out, end-all (a reset of the passphrase; no token) ends all of the account. A session ends half an hour after its last touch, or eight hours
after its start, whichever comes first; what comes later finds nothing. Each session that ends is one row: account, token, started,
ended, reason (signed-out, ended-all, idle, expired).

The state is a map of an account's open sessions, kept by Spark's state store (RocksDB) and checkpointed, so a stream that is started again
carries on; a timer for each session fires once the watermark has passed its end. Python workers run it, a key at a time; an
account's rows are read as they come, sorted within a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from folioworks.operators.lifecycle import IDLE_MINUTES, SESSION_HOURS

IDLE, LONGEST = IDLE_MINUTES * 60_000, SESSION_HOURS * 3_600_000
ENDED = "account string, token string, started timestamp, ended timestamp, reason string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def deadline(started: int, seen: int) -> tuple[int, str]:
    """When a session ends by itself, in milliseconds, and by which clock."""
    return (started + LONGEST, "expired") if started + LONGEST <= seen + IDLE else (seen + IDLE, "idle")


class Sessions(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "token string", "started long, seen long")

    def rows(self, account: str, ended: list[tuple]) -> Iterator[pd.DataFrame]:
        if ended:
            token, started, at, reason = zip(*ended, strict=True)
            time = lambda v: pd.to_datetime(pd.Series(v, dtype="int64"), unit="ms")
            yield pd.DataFrame({"account": [account] * len(ended), "token": token, "started": time(started), "ended": time(at), "reason": reason})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        came = sorted((int(r.ms), int(r.seq), r.event, r.token) for part in rows for r in part.itertuples())
        ended = []
        for at, _, event, token in came:
            if event == "end-all":
                held = [((k[0]), int(v[0]), int(v[1])) for k, v in self.open.iterator()]
            elif token is not None and self.open.containsKey((token,)):
                started, seen = self.open.getValue((token,))
                held = [(token, int(started), int(seen))]
            else:
                held = []
                if event == "start" and token is not None:
                    self.open.updateValue((token,), (at, at))
                    self.handle.registerTimer(deadline(at, at)[0])
            for name, started, seen in held:
                if at >= deadline(started, seen)[0]:
                    continue  # it has ended by itself; its timer says so
                if event == "touch":
                    self.open.updateValue((name,), (started, max(at, seen)))
                elif event in ("end", "end-all"):
                    self.open.removeKey((name,))
                    ended.append((name, started, at, "signed-out" if event == "end" else "ended-all"))
        yield from self.rows(key[0], ended)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        fired, now, ended = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs(), []
        for (token,), (started, seen) in list(self.open.iterator()):
            at, reason = deadline(int(started), int(seen))
            if at <= now:
                self.open.removeKey((token,))
                ended.append((token, int(started), at, reason))
            elif deadline(int(started), int(started))[0] <= fired:
                self.handle.registerTimer(at)  # it was touched since
        yield from self.rows(key[0], ended)

    def close(self) -> None:
        pass


def session_ends(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """The sessions of a stream of events that have ended; events later than `late` are left out, and so are rows without an account or a time."""
    timed = events.where("account is not null and at is not null").select(F.col("account").cast("string").alias("account"), F.col("token").cast("string").alias("token"), "at", F.unix_millis("at").alias("ms"), F.col("seq").cast("long").alias("seq"), "event")
    return timed.withWatermark("at", late).groupBy("account").transformWithStateInPandas(Sessions(), ENDED, "append", "eventtime")


def with_state_store(spark: SparkSession) -> None:
    """The store that holds maps and timers."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
