"""Watching running experiments as streams. What a stream has seen lies in its state store, keyed, so a batch never reads its
target again; batches write to folders of their own, so one that is repeated replaces itself."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

BINARY = "path string, modificationTime timestamp, length long, content binary"


@contextlib.contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in RocksDB, which the streams of this module need; the session's setting
    comes back afterwards."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _existing(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:  # the target does not exist before the first batch
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def _run_of(spark: SparkSession, checkpoint: str) -> tuple[str, bool]:
    """A name that lives and dies with the checkpoint, and whether it is new: batches of a checkpoint that was lost keep their
    folders when a new one counts from 0 again."""
    known = _existing(spark, f"{checkpoint}/run-name", "run string").collect()
    if known:
        return known[0]["run"], False
    run = uuid.uuid4().hex[:12]
    spark.createDataFrame([(run,)], "run string").coalesce(1).write.parquet(f"{checkpoint}/run-name")
    return run, True


class Once(StatefulProcessor):
    """Lets the first row of each key pass, of several in one batch the first in order of `order`. Keys of the initial state
    have been seen. With `ready`, a boolean column, rows that are not ready pass unseen, and `ready` tells them apart."""

    def __init__(self, order: Sequence[str], ready: str | None = None):
        self.order, self.ready = list(order), ready

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        self.seen.update((True,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for part in rows:
            if self.ready:
                if len(wait := part[~part[self.ready]]):
                    yield wait
                part = part[part[self.ready]]
            if len(part):
                best = part.sort_values(self.order).iloc[:1]
                first = best if first is None else pd.concat([first, best]).sort_values(self.order).iloc[:1]
        if first is not None and not self.seen.exists():
            self.seen.update((True,))
            yield first

    def close(self) -> None:
        pass


def first_of_each(rows: DataFrame, key: Sequence[str], order: Sequence[str], seen: DataFrame | None, ready: str | None = None) -> DataFrame:
    """The stream's rows, one for each key over its whole life; keys in `seen` (a table, read when the state is new) never.
    Needs the RocksDB state store; the state holds a byte a key."""
    initial = None if seen is None else seen.select(*key).distinct().groupBy(*key)
    return rows.groupBy(*key).transformWithStateInPandas(Once(order, ready), rows.schema, "Append", "None", initialState=initial)


def stream_measure(frames: DataFrame, measure: Callable[[DataFrame], DataFrame], target: str, settings: str, checkpoint: str, schema: str) -> StreamingQuery:
    """Measures new frames (a stream with frame_file) as they come, each once per settings hash. measure gives rows of
    schema without settings_hash. The state knows the frames that were measured; a new checkpoint learns them from the target,
    once."""
    spark = frames.sparkSession
    run, new = _run_of(spark, checkpoint)
    key = ["settings_hash", "frame_file"]
    seen = _existing(spark, target, f"{schema}, settings_hash string").select(*key) if new else None
    todo = first_of_each(frames.withColumn("settings_hash", F.lit(settings)), key, ["frame_file"], seen)

    def batch(df: DataFrame, number: int) -> None:
        measure(df.drop("settings_hash")).withColumn("settings_hash", F.lit(settings)).write.mode("overwrite").parquet(f"{target}/run={run}/batch={number}")

    return todo.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_import(spark: SparkSession, folder: str, log: str, checkpoint: str, settle_s: float = 5.0, now: str | None = None) -> StreamingQuery:
    """Logs files as they appear, once per content (of equal ones the earliest, by path on ties); content has no time limit.
    Files changed within the last settle_s seconds go to a table beside the log that is a source of the same stream, so the next
    batch looks at them again. The state knows the contents; a new checkpoint learns them from the log, once."""
    run, new = _run_of(spark, checkpoint)
    known, waiting = "sha256 string, path string, ts timestamp, bytes long", "sha256 string, path string, ts timestamp, bytes long"
    spark.createDataFrame([], waiting).write.mode("append").parquet(f"{log}-waiting/run={run}/batch=-1")
    files = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", True).load(folder)
    fresh = files.select(F.sha2("content", 256).alias("sha256"), "path", F.col("modificationTime").alias("ts"), F.col("length").alias("bytes"))
    again = spark.readStream.schema(waiting).option("recursiveFileLookup", True).parquet(f"{log}-waiting/run={run}")
    clock = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    rows = fresh.unionByName(again).withColumn("ready", F.col("ts") <= clock - F.make_dt_interval(secs=F.lit(settle_s)))
    out = first_of_each(rows, ["sha256"], ["ts", "path"], _existing(spark, log, known).select("sha256") if new else None, "ready")

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist()
        df.where("not ready").drop("ready").write.mode("overwrite").parquet(f"{log}-waiting/run={run}/batch={number}")
        df.where("ready").drop("ready").write.mode("overwrite").parquet(f"{log}/run={run}/batch={number}")
        df.unpersist()

    return out.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Health(StatefulProcessor):
    """Last level and beat of each experiment. A beat sets timers at two and at five intervals, which report lateness
    without new data."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "level string, beat double, interval double")

    def _row(self, key: tuple, level: str, event: str, at: float) -> pd.DataFrame:
        return pd.DataFrame({"experiment": [key[0]], "level": [level], "event": [event], "at": [pd.Timestamp(round(at * 1e6), unit="us")]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows)).sort_values("ts")
        at, interval, level = new["ts"].iloc[-1].timestamp(), float(new["interval_s"].iloc[-1]), str(new["level"].iloc[-1])
        before = self.state.get()[0] if self.state.exists() else None
        if before is not None and before != level and level == "ok":
            yield self._row(key, level, "recovered", at)
        elif level != "ok" and before != level:
            yield self._row(key, level, "problem", at)
        self.state.update((level, at, interval))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        now = timerValues.getCurrentProcessingTimeInMs()
        for k in (2, 5):
            self.handle.registerTimer(max(int((at + k * interval) * 1000), now + 1))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        level, beat, interval = self.state.get()
        late = timerValues.getCurrentProcessingTimeInMs() / 1000 - beat
        new = "problem" if late > 5 * interval else "warning" if late > 2 * interval else level
        if new != level:
            self.state.update((new, beat, interval))
            yield self._row(key, new, "problem", beat + late)

    def close(self) -> None:
        pass


ALERTS = "experiment string, level string, event string, at timestamp"


def stream_health(beats: DataFrame) -> DataFrame:
    """Alerts of beats(experiment, ts, interval_s, level): changes of level, and beats that stay out. Needs the RocksDB
    state store (spark.sql.streaming.stateStore.providerClass)."""
    return beats.groupBy("experiment").transformWithStateInPandas(Health(), ALERTS, "Update", "ProcessingTime")


def stream_series_window(points: DataFrame, by: list[str], delay: str = "2 days") -> DataFrame:
    """Daily mean and number of rows of a stream of points(by, ts, y) as they come; rows up to `delay` late count."""
    return points.withWatermark("ts", delay).groupBy(*by, F.window("ts", "1 day").alias("w")).agg(F.avg("y").alias("y"), F.count(F.lit(1)).alias("n_frames")).select(*by, F.to_date("w.start").alias("day"), "y", "n_frames")


def stream_daily(points: DataFrame, by: Sequence[str], zone: str = "UTC", how: str = "median", delay: str = "2 days") -> DataFrame:
    """The rows of daily_series (by, day, y, ts_mid, n_frames) of a stream of points(by, ts, y, excluded): whenever a batch has
    rows of a local day, that day's row over all its rows so far, late ones too as long as the newest row is less than `delay`
    ahead of the day's end, by the zone's clock. Other days give no row. The state holds the open days' values; rows without a
    time have no day."""
    y = {"median": F.percentile("y", 0.5), "mean": F.avg("y"), "p90": F.percentile("y", 0.9)}[how]
    sec = F.col("ts").cast("timestamp").cast("double")
    used = points.withColumn("__local", F.from_utc_timestamp("ts", zone)).withWatermark("__local", delay).where(~F.col("excluded"))
    days = used.groupBy(*by, F.window("__local", "1 day").alias("w")).agg(y.alias("y"), F.percentile(sec, 0.5).alias("ts_mid"), F.count(F.lit(1)).alias("n_frames"))
    # windows begin at whole days of the epoch, whatever the session's zone
    day = F.date_from_unix_date(F.floor(F.unix_seconds("w.start") / 86400).cast("int"))
    return days.select(*by, day.alias("day"), "y", "ts_mid", "n_frames")


def write_days(days: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Writes the rows of stream_daily with the version (batch) they belong to; see latest_days."""
    run, _ = _run_of(days.sparkSession, checkpoint)

    def batch(df: DataFrame, number: int) -> None:
        df.withColumn("version", F.lit(number)).write.mode("overwrite").parquet(f"{target}/run={run}/batch={number}")

    return days.writeStream.foreachBatch(batch).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_days(target: DataFrame, by: list[str]) -> DataFrame:
    """The newest version of each day that write_days wrote."""
    rest = [c for c in target.columns if c not in (*by, "day", "version", "batch", "run")]
    return target.groupBy(*by, "day").agg(F.max_by(F.struct(*rest), "version").alias("v")).select(*by, "day", *(f"v.{c}" for c in rest))
