"""Streams over several micro-batches with late rows against the same folds over all rows at once; state that empties."""

import random

import pytest
from pyspark.sql import Row, functions as F

from subtide.streaming import spans as x

CUES = "track_id bigint, cue_no bigint, ts timestamp, start_ms bigint, end_ms bigint, style string, text string"
MESSAGES = "video_id bigint, no bigint, ts timestamp, kind string, value double"
HOUR = 3600


def written(spark, path, schema, parts):
    """A stream of one file a micro-batch."""
    for i, rows in enumerate(parts):
        made = spark.createDataFrame([(*r[:2], r[2], *r[3:]) for r in rows], schema.replace("timestamp", "bigint"))
        made.withColumn("ts", F.timestamp_seconds("ts")).coalesce(1).write.parquet(f"{path}/part={i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{path}/part=*")


def shuffled(rows, n, late, rnd):
    """``rows`` in order of time in ``n`` parts, with some a part late."""
    rows = sorted(rows, key=lambda r: r[2])
    parts = [[] for _ in range(n)]
    for i, r in enumerate(rows):
        at = i * n // len(rows)
        parts[min(n - 1, at + (rnd.random() < late))].append(r)
    for p in parts:
        rnd.shuffle(p)
    return parts


def state_rows(spark, stream, path):
    query = stream.writeStream.outputMode("update").option("checkpointLocation", path).trigger(availableNow=True).format("noop").start()
    query.awaitTermination()
    return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


@pytest.fixture()
def rocksdb(spark):
    before = spark.conf.get(x.STATE_STORE)
    spark.conf.set(x.STATE_STORE, x.ROCKSDB)
    yield
    spark.conf.set(x.STATE_STORE, before)


def runs(rows):
    out = []
    for track in {r[0] for r in rows}:
        run, done, open_ = x._fold_runs(None, [(r[1], *r[3:]) for r in sorted(rows) if r[0] == track])
        out += [(track, *r) for r in [*done, *open_]]
    return sorted(out)


def test_runs_over_late_batches_equal_the_batch(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(t, n, 1000 * HOUR + n * HOUR + t, n * 100, n * 100 + rnd.randint(1, 300), "s", rnd.choice(["aa", "aa", "bb", "c", None])) for t in range(4) for n in range(60)]
    stream = written(spark, str(tmp_path / "in"), CUES, shuffled(rows, 4, 0.3, rnd))
    got = x.run_available(x.dedup_stream(stream, late="40 hours"), ["track_id", "cue_no"])
    assert sorted(map(tuple, got.collect())) == runs(rows)


def test_reports_over_late_batches_equal_the_batch(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(v, n, 1000 * HOUR + n * HOUR, rnd.choice(["start", "span", "span", "update", "end"]), float(rnd.randint(1, 9))) for v in range(5) for n in range(50)]
    stream = written(spark, str(tmp_path / "in"), MESSAGES, shuffled(rows, 3, 0.3, rnd))
    got = x.run_available(x.video_reports(stream, late="40 hours"), ["video_id", "start_no"])
    want = []
    for v in range(5):
        _, made, _ = x._fold_reports(None, [(r[1], r[3], r[4]) for r in sorted(rows) if r[0] == v])
        want += [(v, *r) for r in made]
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


def test_keys_leave_the_state(spark, tmp_path, rocksdb):
    """Ended videos go when the watermark has passed them, an open one when it has been idle; the last key pushes the watermark on."""
    one = [(v, 1, 1000 * HOUR, "start", 0.0) for v in range(20)] + [(v, 2, 1001 * HOUR, "end", 0.0) for v in range(19)]
    parts = [one, [(100, 1, 1100 * HOUR, "start", 0.0)], [(101, 1, 1200 * HOUR, "start", 0.0)], [(102, 1, 3000 * HOUR, "start", 0.0)], [(103, 1, 3100 * HOUR, "start", 0.0)]]
    stream = x.video_reports(written(spark, str(tmp_path / "in"), MESSAGES, parts), late="1 hour", idle_ms=240 * HOUR * 1000)
    rows = state_rows(spark, stream, str(tmp_path / "out"))
    assert max(rows) >= 20 and rows[-1] < 8


def test_status_counts_close_windows(spark, tmp_path):
    kind = "event_id bigint, user_id bigint, ts timestamp, event_type string"
    day = 24 * HOUR
    rows = [(1, 7, 10 * day, "view"), (2, 7, 10 * day + 5, "purchase"), (3, 8, 10 * day, "error"), (4, 9, 10 * day, "view"), (5, 7, 11 * day, "signup"), (6, 7, 12 * day, "view"), (7, 7, 20 * day, "view")]
    got = x.run_available(x.status_counts(written(spark, str(tmp_path / "in"), kind, [rows[:3], rows[3:6], rows[6:]]), late="1 day"), ["start"], "append")
    assert sorted(tuple(r)[1:] for r in got.collect()) == [(0, 0, 0, 1), (0, 0, 1, 0), (1, 1, 0, 1)]


def test_a_new_key_asks_the_state_four_times():
    """Each call goes to the state server and back, so what waits of a key is stored as one value, and a key that is new has no timers to look for."""
    calls = []

    class Fake:
        def __getattr__(self, name):
            return lambda *args: calls.append(name) or (Fake() if name.endswith("State") else None)

    class Times:
        getCurrentWatermarkInMs = lambda self: 0  # noqa: E731, N815

    taken = Row("at_ms", "no", "kind", "value")
    processor = x._Ordered(x._fold_reports, "no bigint, kind string, value double", "start_no bigint", ["video_id", "start_no", "n_spans", "total_ms", "n_updates", "live"], 1000)
    processor.init(Fake())
    calls.clear()
    rows = [taken(1000 + n, n, {0: "start", 49: "end"}.get(n, "span"), 1.0) for n in range(50)]
    assert [tuple(r) for r in processor.handleInputRows((7,), iter(rows), Times())] == [(7, 0, 48, 48.0, 0, True)]
    assert sorted(calls) == ["get", "get", "registerTimer", "update"]
