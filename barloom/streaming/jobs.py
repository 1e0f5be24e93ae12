"""Structured Streaming jobs: bars, alert de-duplication, exit alerts, guarded append, expiry, staleness.

Each transformation takes a streaming (or batch) DataFrame, so the same code runs on
both and can be checked against the batch answer.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import date
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType, TimestampType

from barloom.operators import quality
from barloom.sources import storage

c = F.col


def tumbling_bars(ticks: DataFrame, every: str = "1 day", lateness: str = "1 day") -> DataFrame:
    """Open, high, low, close and volume per key and window; later rows than the watermark drop."""
    at = F.struct("ts", "event_id")
    return (
        ticks.withWatermark("ts", lateness)
        .groupBy("symbol", F.window("ts", every))
        .agg(
            F.min_by("price", at).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", at).alias("close"),
            F.count("*").alias("n"),
        )
        .select("symbol", F.to_date("window.start").alias("date"), "open", "high", "low", "close", "n")
    )


def alerts_once(alerts: DataFrame, lateness: str = "2 days") -> DataFrame:
    """At most one alert per (symbol, date, type).

    The date is part of the key, so state older than the watermark cannot be hit again.
    """
    keys = ["symbol", "date", "alert_type"]
    if alerts.isStreaming:
        return alerts.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(keys).select(*keys)
    return alerts.select(*keys).distinct()


MOVES = "kind string, symbol long, position_id long, ts timestamp, entry_price double, stop_loss double, target double, low double, high double, close double, rsi double, prev_low double"
EXITS = "symbol long, position_id long, ts timestamp, date date, alert_type string"


def moves(prices: DataFrame, opened: DataFrame, closed: DataFrame, lanes: int = 1) -> DataFrame:
    """One stream of price, open and close events, dealt by (symbol, lane).

    A position lives in one lane of its symbol, a price goes to all of them, so a symbol with very
    many positions is followed by several tasks.
    """
    names = [x.split()[0] for x in MOVES.split(", ")]

    def part(df: DataFrame, kind: str, lane: Column) -> DataFrame:
        have = {n: c(n).cast(t) if n in df.columns else F.lit(None).cast(t) for n, t in (x.split() for x in MOVES.split(", "))}
        return df.select(F.lit(kind).alias("kind"), *[have[n].alias(n) for n in names[1:]], lane.alias("lane"))

    own = F.pmod(F.xxhash64("position_id"), F.lit(lanes)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))
    return part(opened, "open", own).unionByName(part(closed, "close", own)).unionByName(part(prices, "price", every))


class OpenPositions(StatefulProcessor):
    """Open positions of a symbol; each price is held against all of them, events in the order of their time.

    At one time openings come first, then prices, then closings.  A position leaves the state when it
    closes; a price that arrives in a later batch than the closing finds it gone.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        limits = StructType([StructField(n, DoubleType()) for n in ("entry_price", "stop_loss", "target")])
        self.held = handle.getMapState("held", StructType([StructField("position_id", LongType())]), limits)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(rows)
        pdf = pdf.assign(_turn=pdf["kind"].map({"open": 0, "price": 1, "close": 2})).sort_values(["ts", "_turn"], kind="stable")
        before = {k[0]: tuple(v) for k, v in self.held.iterator()}
        held = dict(before)
        out = []
        for r in pdf.itertuples(index=False):
            if r.kind == "open":
                held[r.position_id] = tuple(None if pd.isna(x) else float(x) for x in (r.entry_price, r.stop_loss, r.target))
            elif r.kind == "close":
                held.pop(r.position_id, None)
            else:
                for number, limits in held.items():
                    kind = exit_kind(*limits, r.low, r.high, r.close, r.rsi, r.prev_low)
                    if kind:
                        out.append((key[0], int(number), r.ts, r.ts.date(), kind))
        for number in before.keys() - held.keys():
            self.held.removeKey((number,))
        for number, limits in held.items():
            if before.get(number) != limits:
                self.held.updateValue((int(number),), limits)
        if out:
            yield pd.DataFrame(out, columns=["symbol", "position_id", "ts", "date", "alert_type"])

    def close(self) -> None:
        pass


def exit_kind(entry, stop, target, low, high, close, rsi, prev_low) -> str | None:
    """The first rung of the exit ladder that a price reaches; missing values reach none (fixed values: 2 percent, RSI 80)."""

    def known(*values) -> bool:
        return not any(v is None or pd.isna(v) for v in values)

    if known(low, stop) and low <= stop:
        return "stop_hit"
    if known(close, stop, entry) and entry and (close - stop) / entry * 100 < 2:
        return "stop_approached"
    if known(high, target) and high >= target:
        return "target_hit"
    if known(close, target, entry) and entry and (target - close) / entry * 100 < 2:
        return "target_approached"
    if known(rsi, close, prev_low) and rsi > 80 and close < prev_low:
        return "overextended_exit"
    return None


def exit_alerts(events: DataFrame) -> DataFrame:
    """Exit alerts of all open positions on arriving prices; ``events`` comes from ``moves``."""
    return events.groupBy("symbol", "lane").transformWithStateInPandas(
        statefulProcessor=OpenPositions(), outputStructType=EXITS, outputMode="Append", timeMode="None"
    )


def logged_once(path: str, keys: tuple[str, ...] = ("symbol", "date", "alert_type")):
    """``foreachBatch`` body: the first alert of each key goes to the log, those already there do not.

    The log is partitioned by day and a batch rewrites its own days, so a batch that is replayed after
    a lost executor or a restart changes nothing.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("day", c("date").cast("string")).persist()
        stored = storage.read_or_empty(spark, path, batch.schema)
        days = batch.select("day").distinct()
        prior = stored.join(F.broadcast(days), "day", "left_semi")
        rest = [x for x in batch.columns if x not in keys]
        first = batch.join(prior.select(*keys), list(keys), "left_anti").groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*")
        merged = prior.select(*batch.columns).unionByName(first.select(*batch.columns))
        if not first.isEmpty():
            storage.write_partitions(storage.cut_lineage(merged), path, ["day"])
        batch.unpersist()

    return write


class DriftError(RuntimeError):
    """Stored history changed and no event explains it."""


def guarded_append(path: str, events: DataFrame | None = None):
    """``foreachBatch`` body: check the overlap with stored rows, then rewrite the batch's days.

    Partitions are days, overwritten dynamically, so replaying a batch after a lost
    executor or a restart gives the same table.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        schema = batch.withColumn("day", c("date").cast("string")).schema
        stored = storage.read_or_empty(spark, path, schema)
        days = batch.select(c("date").cast("string").alias("day")).distinct()
        prior = stored.join(F.broadcast(days), "day", "left_semi")
        explained = events if events is not None else batch.select("isin").filter(F.lit(False))
        drift = quality.violations(quality.drift_guard(prior, batch, explained))
        bad = drift.limit(5).collect()  # names for the message only
        if bad:
            raise DriftError(f"unexplained drift in {[r['isin'] for r in bad]}")
        # Rows of the same days that this batch does not carry stay.
        keep = prior.join(batch.select("isin", "date"), ["isin", "date"], "left_anti")
        merged = batch.withColumn("day", c("date").cast("string")).unionByName(keep.select(*batch.columns, "day"))
        storage.write_partitions(storage.cut_lineage(merged), path, ["day"])

    return write


DAY_MS = 86_400_000


class WatchEntries(StatefulProcessor):
    """Watch entries of a symbol, each from its signal date; emits one when ``limit`` sessions are passed.

    An entry has passed its limit once limit + 1 distinct sessions lie after its signal date, that is,
    once the (limit + 1)-th newest session does.  So a symbol keeps that many dates, whatever their
    order of arrival and however often they repeat, and its open entries.  Expired entries leave the
    state at once; with ``keep_days``, dates and entries nobody touches leave it after so many days.
    """

    def __init__(self, limit: int = 8, keep_days: int | None = None):
        self.limit, self.ttl = limit, None if keep_days is None else keep_days * DAY_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sessions = handle.getValueState("sessions", StructType([StructField("dates", StringType())]), self.ttl)
        self.entries = handle.getMapState("entries", StructType([StructField("entry_id", LongType())]), StructType([StructField("signal_date", StringType())]), self.ttl)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        kept = self.sessions.get()[0].split(",") if self.sessions.exists() else []
        entries = {k[0]: v[0] for k, v in self.entries.iterator()}
        days, opened = set(kept), {}
        for pdf in rows:
            at = pdf["date"].astype(str)
            days |= set(at[pdf["entry_id"].isna()])
            new = pdf["entry_id"].notna()
            opened |= dict(zip(pdf["entry_id"][new].astype("int64"), at[new]))
        newest = sorted(days)[-self.limit - 1 :]
        if newest != kept:
            self.sessions.update((",".join(newest),))
        past = newest[0] if len(newest) > self.limit else ""
        out = []
        for number, signal in (entries | opened).items():
            if past > signal:
                out.append((key[0], int(number), date.fromisoformat(signal)))
                if number in entries:
                    self.entries.removeKey((number,))
            elif number in opened:
                self.entries.updateValue((int(number),), (signal,))
        if out:
            yield pd.DataFrame(out, columns=["symbol", "entry_id", "signal_date"])

    def close(self) -> None:
        pass


def expired_watches(entries: DataFrame, sessions: DataFrame, limit: int = 8, keep_days: int | None = None) -> DataFrame:
    """Watch entries (symbol, entry_id, signal_date) that passed their limit of sessions (symbol, date).

    ``keep_days`` goes by the clock, so it is for streams that run on: a run over what is available now
    would have no end with it.
    """
    both = entries.select("symbol", c("entry_id").cast("long").alias("entry_id"), c("signal_date").alias("date")).unionByName(
        sessions.select("symbol", F.lit(None).cast("long").alias("entry_id"), "date")
    )
    return both.groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=WatchEntries(limit, keep_days),
        outputStructType="symbol long, entry_id long, signal_date date",
        outputMode="Append",
        timeMode="None" if keep_days is None else "ProcessingTime",
    )


def expired_watches_batch(entries: DataFrame, sessions: DataFrame, limit: int = 8) -> DataFrame:
    days = sessions.select("symbol", "date").distinct()
    newest = Window.partitionBy("symbol").orderBy(c("date").desc())
    edge = days.withColumn("_n", F.row_number().over(newest)).filter(c("_n") == limit + 1).select("symbol", c("date").alias("_edge"))
    return entries.join(edge, "symbol").filter(c("_edge") > c("signal_date")).select("symbol", "entry_id", "signal_date")


class LastSeen(StatefulProcessor):
    """Time of the newest row of a source; a processing-time timer fires when no more rows come."""

    def __init__(self, limit_ms: int):
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", StructType([StructField("ts", TimestampType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        newest = max(pdf["ts"].max() for pdf in rows)
        if self.seen.exists():
            newest = max(newest, pd.Timestamp(self.seen.get()[0]))
        self.seen.update((newest.to_pydatetime(),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.limit_ms)
        yield pd.DataFrame({"source": [key[0]], "last_ts": [newest], "stale": [False]})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"source": [key[0]], "last_ts": [pd.Timestamp(self.seen.get()[0])], "stale": [True]})

    def close(self) -> None:
        pass


def stale_sources(rows: DataFrame, source: str, limit_ms: int) -> DataFrame:
    """Per source its newest time with each batch, and once more with ``stale`` when it stops for ``limit_ms``."""
    return rows.select(c(source).alias("source"), "ts").groupBy("source").transformWithStateInPandas(
        statefulProcessor=LastSeen(limit_ms), outputStructType="source string, last_ts timestamp, stale boolean", outputMode="Update", timeMode="ProcessingTime"
    )


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed processors need, for the time of a run."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def watch_until_quiet(flags: DataFrame, checkpoint: str, quiet_s: float, most_s: float = 120.0) -> DataFrame:
    """Run a stream of ``stale_sources`` until every source it saw is flagged, and read the flags.

    Sources are few (feeds, books), so the driver keeps who is flagged.  ``quiet_s`` is the pause between
    looks; after ``most_s`` seconds it stops with what it has.
    """
    spark, out = flags.sparkSession, f"{checkpoint}/out"
    flagged: dict[str, bool] = {}

    def keep(batch: DataFrame, number: int) -> None:
        rows = batch.collect()  # one for each source that moved or stopped
        if rows:
            spark.createDataFrame(rows, flags.schema).coalesce(1).write.mode("overwrite").parquet(f"{out}/batch={number}")
            flagged.update({r["source"]: r["stale"] for r in rows})

    running = flags.writeStream.outputMode("update").option("checkpointLocation", f"{checkpoint}/state").trigger(processingTime="500 milliseconds").foreachBatch(keep).start()
    try:
        end = time.monotonic() + most_s
        while running.isActive and time.monotonic() < end and not (flagged and all(flagged.values())):
            time.sleep(quiet_s)
    finally:
        running.stop()
    if (error := running.exception()) is not None:
        raise error
    return storage.read_or_empty(spark, out, flags.schema).select(*flags.columns)


def staleness(progress: DataFrame, clock: Column, limit_seconds: int, by: str = "alert_type") -> DataFrame:
    """Lag of the newest row per source behind a clock, with a flag."""
    lag = F.unix_timestamp(clock) - F.unix_timestamp(F.max("ts"))
    return progress.groupBy(by).agg(lag.alias("lag_seconds")).withColumn("stale", c("lag_seconds") > limit_seconds)


def drain(stream: DataFrame, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a bounded source to its end and read what came out (tests and registered queries).

    Update-mode output has no file sink, so each batch is written to its own folder;
    a replayed batch overwrites itself.
    """
    spark, out = stream.sparkSession, f"{checkpoint}/out"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{checkpoint}/state").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", out).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer.foreachBatch(keep).start().awaitTermination()
    return storage.read_or_empty(spark, out, stream.schema).select(*stream.columns)
