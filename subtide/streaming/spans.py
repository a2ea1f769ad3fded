"""Streams of spans, messages and cues."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window, functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from subtide.session import fresh_path, table


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as a stream of its files."""
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").option("recursiveFileLookup", "false").parquet(sf)


#: State that Python folds keep lies in RocksDB, on disk.
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(stream: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    """Runs ``stream`` over what is there now and returns the last row of each of ``keys``, without those that are no longer ``live``.

    Micro-batches are written to the shared folder with their number, so a batch that is repeated after a failure replaces itself.
    """
    spark = stream.sparkSession
    out = fresh_path(spark, "stream")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", fresh_path(spark, "progress")).trigger(availableNow=True).foreachBatch(put).start()
    finally:
        spark.conf.set(STATE_STORE, before)
    query.awaitTermination()
    rows = spark.read.schema(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields) + ", batch int").parquet(out)
    w = Window.partitionBy(*keys).orderBy(F.desc("batch"))
    last = rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "batch")
    return last.where("live").drop("live") if "live" in last.columns else last


def span_stream(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Count and total duration of spans by name and tumbling window, with a watermark."""
    named = events.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("name"), (F.col("value") * 10).alias("duration_ms"))
    return named.withWatermark("ts", late).groupBy(F.window("ts", window), "name").agg(F.count(F.lit(1)).alias("n"), F.sum("duration_ms").alias("total_ms")).select(F.col("window.start").alias("start"), "name", "n", "total_ms")


# How a file stands by its last stage; other stages are under way.
STATUS = {"purchase": "completed", "error": "failed", "signup": "skipped"}


def _status(stage: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in STATUS.items() for v in kv]), stage), F.lit("running"))


def progress_table(events: DataFrame) -> DataFrame:
    """Per file (user): its latest stage and status, how many lines are done of how many, units, and lines done a second between its first and last event (0 without time)."""
    last = F.max_by("event_type", F.struct("ts", "event_id"))
    took = F.timestamp_diff("MICROSECOND", F.min(F.col("ts").cast("timestamp")), F.max(F.col("ts").cast("timestamp")))
    counted = events.groupBy(F.col("user_id").alias("file_id")).agg(
        last.alias("stage"), F.count_if(F.col("event_type") != "error").alias("done"), F.count(F.lit(1)).alias("total"), F.sum("value").alias("units"), took.alias("_took")
    )
    rate = F.when(F.col("_took") > 0, F.col("done") * 1e6 / F.col("_took")).otherwise(0.0)
    return counted.select("file_id", "stage", _status(F.col("stage")).alias("status"), "done", "total", "units", rate.alias("rate"))


def status_counts(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Per window how many of its files ended it completed, failed, skipped or still running.

    Two aggregates one after the other, by file and then by status, both closed by the watermark: a window comes out once, when
    it lies ``late`` behind the latest event, and its state is dropped then.
    """
    timed = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_id", "user_id", "event_type").withWatermark("ts", late)
    files = timed.groupBy(F.window("ts", window), "user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("stage"))
    per_window = files.groupBy(F.window(F.window_time("window"), window)).agg(*[F.count_if(_status(F.col("stage")) == x).alias(x) for x in ("completed", "failed", "skipped", "running")])
    return per_window.select(F.col("window.start").alias("start"), "completed", "failed", "skipped", "running")


#: One key's rows in order, folded: state (or None) and rows to the new state (None: nothing is open), rows that are final, rows that may still change.
Fold = Callable[[tuple | None, list[tuple]], tuple[tuple | None, list[tuple], list[tuple]]]


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


class _Ordered(StatefulProcessor):
    """Folds the rows of a key in order of ``no`` though they arrive late, and gives what changed.

    Rows wait until the watermark has passed them, since earlier ones may still come; what they give is given at once, and again
    when a late row changes it: ``live`` is false for a row that isn't so any more. Rows the watermark has passed go into the folded state.
    Timers do so where no more rows come, and then let a key go that has nothing open, or whose last row lies ``idle`` behind the watermark.
    """

    def __init__(self, fold: Fold, row_type: str, state_type: str, out: list[str], idle_ms: int):
        self.fold, self.state_type, self.out, self.idle_ms = fold, state_type, Row(*out), idle_ms
        self.taken = ["at_ms", *_names(row_type)]
        self.waiting_type = ", ".join(f"{name} array<{kind}>" for name, kind in (part.split() for part in f"at_ms bigint, {row_type}".split(", ")))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", self.state_type)
        self.waiting = handle.getValueState("waiting", self.waiting_type)  # an array a column: rows of their own would each be sent and stored by themselves

    def _given(self, state: tuple | None, rows: list[tuple]) -> dict[int, tuple]:
        _, final, open_ = self.fold(state, [r[1:] for r in sorted(rows, key=lambda r: r[1])]) if rows else (None, [], [])
        return {r[0]: r for r in [*final, *open_]}

    def _held(self) -> tuple[tuple | None, list[tuple]]:
        """The folded state and the rows that wait."""
        state, columns = self.settled.get(), self.waiting.get()
        return (None if state is None else tuple(state)), ([] if columns is None else list(zip(*columns)))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        state, old = self._held()
        new = old + [tuple(None if v != v else v for v in (r[name] for name in self.taken)) for r in rows]
        before, after = self._given(state, old), self._given(state, new)
        changed = [(*r, True) for k, r in after.items() if before.get(k) != r] + [(*r, False) for k, r in before.items() if k not in after]
        self._settle(state, bool(old), new, timerValues.getCurrentWatermarkInMs(), max(r[0] for r in new) + self.idle_ms)
        return iter([self.out(key[0], *r) for r in changed])

    def _settle(self, before: tuple | None, waited: bool, rows: list[tuple], passed: int, idle_at: int) -> None:
        """Folds what the watermark has passed; the rest waits. The next timer is when it has passed that too, else when the key has been idle. A key that had neither state nor waiting rows has no timer."""
        state, _, _ = self.fold(before, [r[1:] for r in sorted((r for r in rows if r[0] <= passed), key=lambda r: r[1])])
        rest = [r for r in rows if r[0] > passed]
        if waited or before is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        if rest:
            self.waiting.update(tuple(list(column) for column in zip(*rest)))
            self.handle.registerTimer(max(r[0] for r in rest) + 1)
        elif waited:
            self.waiting.clear()
        if state is not None:
            if state != before:
                self.settled.update(state)
            if not rest:
                self.handle.registerTimer(idle_at)
        elif before is not None:
            self.settled.clear()

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        state, rows = self._held()
        if rows:
            self._settle(state, True, rows, timerValues.getCurrentWatermarkInMs(), max(r[0] for r in rows) + self.idle_ms)
        else:
            self.settled.clear()
        return iter(())

    def close(self) -> None:
        pass


def _ordered(rows: DataFrame, key: str, ts: str, row_type: str, state_type: str, out_type: str, fold: Fold, late: str, idle_ms: int) -> DataFrame:
    names = _names(row_type)
    at = F.unix_millis(F.col(ts).cast("timestamp"))
    timed = rows.select(F.col(ts).cast("timestamp").alias("event_ts"), F.col(key), at.alias("at_ms"), *names).withWatermark("event_ts", late).select(key, "event_ts", "at_ms", *names)
    schema = f"{key} bigint, {out_type}, live boolean"
    processor = _Ordered(fold, row_type, state_type, _names(schema), idle_ms)
    return timed.groupBy(key).transformWithState(processor, schema, "Update", "EventTime")


DAY_MS = 86_400_000


def _fold_reports(state: tuple | None, rows: list[tuple]) -> tuple[tuple | None, list[tuple], list[tuple]]:
    made = []
    for no, kind, value in rows:
        if kind == "start":
            state = (no, 0, 0.0, 0)
        elif state is not None and kind == "end":
            made.append(state)
            state = None
        elif state is not None and kind == "span":
            state = (state[0], state[1] + 1, state[2] + (value or 0.0), state[3])
        elif state is not None and kind == "update":
            state = (*state[:3], state[3] + 1)
    return state, made, []


def video_reports(messages: DataFrame, late: str = "2 days", idle_ms: int = 30 * DAY_MS) -> DataFrame:
    """Start, span, update and end messages (video_id, no, ts, kind, value) folded into a row per ended video; ``live`` as in _Ordered.

    A start opens a video (dropping an open one), an end closes it; spans and updates without an open one are dropped. ``no`` (unique in
    its video) orders messages and rises with ``ts``. start_no is the start's. An ended video leaves the state, one left open after ``idle_ms``.
    """
    out = "start_no bigint, n_spans bigint, total_ms double, n_updates bigint"
    return _ordered(messages, "video_id", "ts", "no bigint, kind string, value double", "start_no bigint, spans bigint, total double, updates bigint", out, _fold_reports, late, idle_ms)


def _fold_runs(run: tuple | None, rows: list[tuple]) -> tuple[tuple | None, list[tuple], list[tuple]]:
    done = []
    for no, start, end, style, text in rows:
        text = (text or "").strip()
        if len(text) < 2:
            continue
        if run is not None and run[4] == text:
            run = (*run[:2], max(run[2], end), *run[3:])
        else:
            if run is not None:
                done.append(run)
            run = (no, start, end, style, text)
    return run, done, [] if run is None else [run]


def dedup_stream(cues: DataFrame, late: str = "2 days", idle_ms: int = 30 * DAY_MS) -> DataFrame:
    """Runs of equal text on arriving cues (track_id, cue_no, ts, start_ms, end_ms, style, text), texts under two characters dropped; ``live`` as in _Ordered.

    A run's last row with its (track_id, cue_no) says how it stands. cue_no (unique in its track) rises with ``ts``, when a cue was
    made. A track's last run stays open until nothing has come for ``idle_ms``.
    """
    kind = "cue_no bigint, start_ms bigint, end_ms bigint, style string, text string"
    return _ordered(cues, "track_id", "ts", kind, kind, kind, _fold_runs, late, idle_ms)
