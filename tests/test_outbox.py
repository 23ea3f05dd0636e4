"""The streamed outbox: two workers, a crash between claim and settling, restarts; against the batch form and a plain one."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.operators import state
from tessera.streaming import outbox

T0 = datetime(2024, 1, 1)
EVENT = "queue long, at timestamp, n long, kind string, id long, created_at timestamp, worker string, most int, error string"
LEASE = 150


def event(s, kind, n, queue=0, i=None, created=None, worker=None, most=None, error=None):
    return (queue, T0 + timedelta(seconds=s), n, kind, i, None if created is None else T0 + timedelta(seconds=created), worker, most, error)


def told(spark, folder, batches):
    """Each list of rows as a micro-batch; the query is started anew for each, as after a crash."""
    for rows in batches:
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(EVENT).parquet(f"{folder}/in")
        q = outbox.outbox_stream(source, lease_ms=LEASE * 1000).writeStream.format("parquet").outputMode("append")
        q = q.option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    out = [tuple(r) for r in spark.read.schema(outbox.OUT).parquet(f"{folder}/out").collect()]
    ms = int((T0 - datetime(1970, 1, 1)).total_seconds() * 1000)
    out = [(q, (at - ms) // 1000, what, i, w, n, until and (until - ms) // 1000) for q, at, what, i, w, n, until in out]
    return sorted(out, key=lambda x: x[:2])  # rows of one time stay as they came


CRASH = [
    [event(0, "put", 1, i=1, created=-20), event(0, "put", 2, i=2, created=-30), event(0, "put", 3, i=3, created=-10), event(1, "ask", 4, worker="a", most=2)],
    # a crashes: it settles nothing; b gets what is left, and nothing twice
    [event(5, "ask", 5, worker="b", most=5), event(9, "done", 6, worker="b", i=3), event(20, "ask", 7, worker="b", most=5)],
    # the leases end at 151; the timer tells of it once the watermark has passed
    [event(140, "ask", 8, worker="b", most=5)],
    [event(160, "ask", 9, worker="b", most=1), event(161, "done", 10, worker="b", i=2, error="no answer")],
    # a comes back: its failure is stale, its success counts
    [event(170, "done", 11, worker="a", i=2, error="late"), event(171, "ask", 12, worker="a", most=5), event(172, "done", 13, worker="b", i=1)],
    [event(190, "ask", 14, worker="b", most=5), event(191, "ask", 15, worker="b", most=5), event(192, "put", 16, i=3, created=0), event(193, "done", 17, worker="b", i=2)],
    [event(900, "ask", 18, worker="a", most=5)],
]


def test_crash_between_claim_and_settling(spark, tmp_path):
    got = told(spark, str(tmp_path), CRASH)
    assert [x[1:] for x in got if x[2] != "due"] == [
        (1, "claim", 2, "a", 0, 151), (1, "claim", 1, "a", 0, 151),
        (5, "claim", 3, "b", 0, 155), (9, "forwarded", 3, "b", 0, None),
        (160, "claim", 2, "b", 0, 310), (161, "failed", 2, "b", 1, 191),
        (170, "stale", 2, "a", 1, None), (171, "claim", 1, "a", 0, 321), (172, "forwarded", 1, "b", 0, None),
        (191, "claim", 2, "b", 1, 341), (193, "forwarded", 2, "b", 1, None),
    ]
    assert [x[1:4] for x in got if x[2] == "due"] == [(151, "due", 1)]  # 2 has a new lease by then


def plain(rows):
    """The rows out but for ``due``, by a plain loop over all words; the words' ends."""
    words, out = {}, []
    for queue, at, n, kind, i, created, worker, most, error in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        s = int((at - T0).total_seconds())
        own = {k: w for k, w in words.items() if w["queue"] == queue}
        if kind == "put":
            words.setdefault(i, {"queue": queue, "created": created, "attempts": 0, "due": -1, "holder": None, "end": None})
        elif kind == "delete" and i in own and not own[i]["end"]:
            own[i]["end"] = "deleted"
        elif kind == "ask":
            for k in sorted((k for k, w in own.items() if not w["end"] and w["due"] <= s), key=lambda k: (own[k]["created"], k))[:most]:
                own[k].update(due=s + LEASE, holder=worker)
                out.append((queue, s, "claim", k, worker, own[k]["attempts"], s + LEASE))
        elif kind == "done" and i in own and not own[i]["end"]:
            w = own[i]
            if error is None:
                w["end"] = "forwarded"
                out.append((queue, s, "forwarded", i, worker, w["attempts"], None))
            elif w["holder"] == worker:
                w["attempts"] += 1
                w.update(due=s + outbox.wait_ms(w["attempts"]) // 1000, holder=None)
                out.append((queue, s, "failed", i, worker, w["attempts"], w["due"]))
            else:
                out.append((queue, s, "stale", i, worker, w["attempts"], None))
    return out, words


@pytest.fixture(scope="module")
def busy():
    """Three queues, workers that fail, answer late or not at all."""
    rng = random.Random(7)
    rows, n, s = [], 0, 0
    for i in range(30):
        rows.append(event(rng.randint(0, 300), "put", n := n + 1, queue=i % 3, i=i, created=rng.randint(-100, 0)))
    for _ in range(160):
        s += rng.randint(1, 9)
        n, queue, worker = n + 1, rng.randint(0, 2), rng.choice("abc")
        kind = rng.choice(["ask", "ask", "done", "done", "done", "put", "delete"])
        i = rng.randint(0, 9) * 3 + queue
        rows.append(event(s, kind, n, queue, None if kind == "ask" else i, 0 if kind == "put" else None, worker, 2, rng.choice([None, "no", "no"]) if kind == "done" else None))
    rows.sort(key=lambda r: (r[1], r[2]))
    return [rows[k : k + 50] for k in range(0, len(rows), 50)]


def test_busy_queues_with_restarts(spark, tmp_path, busy):
    rows = [r for b in busy for r in b]
    got = [x for x in told(spark, str(tmp_path), busy) if x[2] != "due"]
    want, words = plain(rows)
    assert sorted(got, key=str) == sorted(want, key=str)
    held, ended = defaultdict(int), set()
    for queue, s, what, i, *rest in sorted(got, key=lambda x: (x[0], x[1])):
        if what == "claim":
            assert s >= held[i] and i not in ended, "sent twice within a lease, or after it was forwarded"
            held[i] = rest[2]
        elif what == "failed":
            held[i] = rest[2]
        elif what == "forwarded":
            ended.add(i)
    assert ended == {i for i, w in words.items() if w["end"] == "forwarded"}
    last = max(r[1] for r in rows)
    more = [event(int((last - T0).total_seconds()) + 90_000, "ask", 10_000, queue=q, worker="z", most=99) for q in range(3)]
    left = {x[3] for x in told(spark, f"{tmp_path}/again", [rows, more]) if x[2] == "claim" and x[4] == "z"}
    assert left == {i for i, w in words.items() if not w["end"]}, "no word is lost"


def test_batch_form(spark, tmp_path):
    """The same claims as ``state.claim`` and the same ends as ``state.settle``, one queue."""
    puts = [event(0, "put", k, i=k, created=-(k * 7 % 5)) for k in range(6)]
    asks = [event(1, "ask", 10, worker="a", most=2), event(2, "ask", 11, worker="b", most=3)]
    ends = [event(3, "done", 12, worker="a", i=4), event(3, "done", 13, worker="a", i=2, error="x" * 600), event(3, "done", 14, worker="b", i=3)]
    got = [x for x in told(spark, str(tmp_path), [puts + asks, ends, [event(200, "ask", 20, worker="c", most=9)]]) if x[2] != "due"]
    words = spark.createDataFrame([(r[4], r[5], None, None, None, 0, None) for r in puts], "id long, created_at timestamp, deleted_at timestamp, forwarded_at timestamp, next_attempt_at timestamp, attempts int, last_error string")
    now = lambda s: F.lit(T0 + timedelta(seconds=s))
    claims = []
    for s, worker, most in ((1, "a", 2), (2, "b", 3)):
        out = state.claim(words, now(s), most, LEASE * 1000)
        claims += [(worker, r["id"]) for r in out.filter("claimed").collect()]
        words = spark.createDataFrame(out.drop("claimed").collect(), words.schema)
    assert sorted(claims) == sorted((x[4], x[3]) for x in got if x[2] == "claim" and x[1] < 100)
    words = state.settle(words, spark.createDataFrame([(4, None), (2, "x" * 600), (3, None)], "id long, error string"), now(3))
    left = [r["id"] for r in state.outbox_due(words, now(200), 9).collect()]
    assert left == [x[3] for x in got if x[1] == 200]
