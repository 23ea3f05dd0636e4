"""An outbox as a stream: words are put, workers ask for some and say how it went.

Words lie in queues, each the state of one key, so a queue's words are handed out in
order and queues spread over tasks. A claim is a lease: until it ends no other worker
gets the word. A worker that falls silent loses its words when their leases end; a
failed attempt makes its word wait out a backoff. Both ends are event-time timers,
which tell of words that are due again and that nobody has claimed since.

Rows in: queue, at (event time), n (order among rows of one time), kind and
- ``put``: id, created_at; a word known already, or forwarded before, is not put again;
- ``delete``: id; the word is owed no more;
- ``ask``: worker, most: the oldest due words, by created_at and id, at most ``most``;
- ``done``: worker, id, error (null: forwarded). A success counts whoever tells it; a
  failure counts if the worker still has the lease, else it is ``stale``.

Rows out: queue, at_ms, what, id, worker, attempts, until_ms, where what is ``claim``,
``forwarded``, ``failed``, ``stale`` or ``due``. The state keeps words that are owed, and for
``keep_ms`` the ids of those that are not any more, against puts that come twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.state import LEASE_MS
from .streams import use_rocksdb

FIRST_WAIT_MS, LONGEST_WAIT_MS = 30_000, 21_600_000
KEEP_MS = 7 * 86_400_000
OUT = "queue long, at_ms long, what string, id long, worker string, attempts int, until_ms long"
COLUMNS = [c.split()[0] for c in OUT.split(", ")]
#: a word that waits for nothing is due from then on
ALWAYS = -(1 << 62)


def wait_ms(attempts: int) -> int:
    return min(FIRST_WAIT_MS << min(40, max(0, attempts - 1)), LONGEST_WAIT_MS)


class OutboxQueue(StatefulProcessor):
    """One queue: owed words by id, and ids of late ones."""

    def __init__(self, lease_ms: int = LEASE_MS, keep_ms: int = KEEP_MS):
        self.lease_ms, self.keep_ms = lease_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.owed = handle.getMapState("owed", "id long", "created long, attempts int, due long, holder string")
        self.gone = handle.getMapState("gone", "id long", "since long")

    def _wait(self, until: int) -> int:
        self.handle.registerTimer(until)
        return until

    def _leave(self, i: int, at: int) -> None:
        self.owed.removeKey((i,))
        self.gone.updateValue((i,), (at,))
        self._wait(at + self.keep_ms)

    def _row(self, queue: int, r) -> Iterator[tuple]:
        at = int(r.at_ms)
        if r.kind == "ask":
            due = sorted((v[0], k[0], v[1]) for k, v in self.owed.iterator() if v[2] <= at)
            for created, i, attempts in due[: int(r.most)]:
                until = self._wait(at + self.lease_ms)
                self.owed.updateValue((i,), (created, attempts, until, r.worker))
                yield queue, at, "claim", i, r.worker, attempts, until
            return
        i = int(r.id)
        word = self.owed.getValue((i,)) if self.owed.containsKey((i,)) else None
        if r.kind == "put" and word is None and not self.gone.containsKey((i,)):
            self.owed.updateValue((i,), (int(r.created_ms), 0, ALWAYS, None))
        elif r.kind == "delete" and word is not None:
            self._leave(i, at)
        elif r.kind == "done" and word is not None:
            created, attempts, _, holder = word
            if pd.isna(r.error):
                self._leave(i, at)
                yield queue, at, "forwarded", i, r.worker, attempts, None
            elif holder == r.worker:
                until = self._wait(at + wait_ms(attempts + 1))
                self.owed.updateValue((i,), (created, attempts + 1, until, None))
                yield queue, at, "failed", i, r.worker, attempts + 1, until
            else:
                yield queue, at, "stale", i, r.worker, attempts, None

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=COLUMNS)
        return out.astype({"queue": "int64", "at_ms": "int64", "id": "int64", "attempts": "int32", "until_ms": "Int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        come = pd.concat(list(rows)).sort_values(["at_ms", "n"], kind="stable")
        yield self._frame([x for r in come.itertuples() for x in self._row(int(key[0]), r)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted((v[0], k[0], v[1]) for k, v in self.owed.iterator() if v[2] == at)
        for (i,) in [k for k, v in self.gone.iterator() if v[0] + self.keep_ms <= at]:
            self.gone.removeKey((i,))
        yield self._frame([(int(key[0]), at, "due", i, None, attempts, None) for _, i, attempts in due])

    def close(self) -> None:
        pass


def outbox_stream(events: DataFrame, late: str = "0 seconds", lease_ms: int = LEASE_MS, keep_ms: int = KEEP_MS) -> DataFrame:
    """What the queues answer to the rows of ``events``; rows later than ``late`` are dropped."""
    use_rocksdb(events.sparkSession)
    marked = events.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late)
    rows = marked.select("at", F.col("queue").cast("long").alias("queue"), F.unix_millis("at").alias("at_ms"), "n", "kind", "id", F.unix_millis(F.col("created_at").cast("timestamp")).alias("created_ms"), "worker", "most", "error")
    return rows.groupBy("queue").transformWithStateInPandas(statefulProcessor=OutboxQueue(lease_ms, keep_ms), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
