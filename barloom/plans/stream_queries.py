"""Registered queries: streaming jobs run to the end of their input."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.plans.oracle_views import rnd
from barloom.plans.registry import query
from barloom.sources import storage
from barloom.sources.views import Views
from barloom.streaming import jobs

c = F.col
DATE = "CAST(date AS VARCHAR) AS date"


def ticks(v: Views):
    """The events table as a stream of priced alerts."""
    static = v.table("events")
    stream = v.spark.readStream.schema(static.schema).option("pathGlobFilter", "events.parquet").parquet(v.root)
    n = v.table("supplier").count()
    return stream.select("event_id", c("ts").cast("timestamp").alias("ts"), F.to_date("ts").alias("date"), (c("user_id") % n).alias("symbol"),
                         c("event_type").alias("alert_type"), c("value").alias("price"))


def place(v: Views, name: str) -> str:
    return storage.scratch_path(v.spark, name)


def bars(v: Views):
    """Windows still open when the input ends are not emitted, hence the cut in the SQL."""
    return jobs.drain(jobs.tumbling_bars(ticks(v)), place(v, "bars"))


query("r01_tumbling_bars", "alerts", f"""
SELECT symbol, {DATE}, {rnd('arg_min(price, k)')} AS open, {rnd('max(price)')} AS high, {rnd('min(price)')} AS low, {rnd('arg_max(price, k)')} AS close, count(*) AS n
FROM (SELECT *, {{'t': ts, 'e': event_id}} AS k FROM alerts) WHERE CAST(date + 1 AS TIMESTAMP) <= (SELECT max(ts) FROM alerts) - INTERVAL 1 DAY GROUP BY symbol, date""")(bars)
query("r03_alerts_once", "alerts", f"SELECT DISTINCT symbol, {DATE}, alert_type FROM alerts")(
    lambda v: jobs.drain(jobs.alerts_once(ticks(v)), place(v, "once")))


def exits(v: Views):
    """Two positions a symbol, one of which closes; one alert for each (symbol, day, kind) in the log."""
    at = lambda t: F.lit(t).cast("timestamp")
    first, second = c("symbol") * 2, c("symbol") * 2 + 1
    stop, goal = c("symbol") % 20 + 1.0, 90.0 + c("symbol") % 20
    book = v.stocks.select("symbol", first.alias("position_id"), F.lit(50.0).alias("entry_price"), stop.alias("stop_loss"), goal.alias("target")).unionByName(
        v.stocks.select("symbol", second.alias("position_id"), F.lit(60.0).alias("entry_price"), (stop + 3).alias("stop_loss"), (goal - 5).alias("target")))
    source = place(v, "book")
    opens = book.withColumns({"kind": F.lit("open"), "ts": at("2000-01-01 00:00:00")})
    closes = book.filter("position_id % 2 = 1").withColumns({"kind": F.lit("close"), "ts": at("2024-01-15 00:00:00")})
    opens.unionByName(closes).coalesce(1).write.mode("overwrite").parquet(source)
    changes = v.spark.readStream.schema(v.spark.read.parquet(source).schema).parquet(source)
    price = c("price")
    prices = ticks(v).select("symbol", "ts", price.alias("low"), price.alias("high"), price.alias("close"), price.alias("rsi"), F.lit(88.0).alias("prev_low"))
    events = jobs.moves(prices, changes.filter("kind = 'open'"), changes.filter("kind = 'close'"), lanes=2)
    log, state = place(v, "exit-log"), place(v, "exit-state")
    with jobs.keyed_state(v.spark):
        (jobs.exit_alerts(events).writeStream.foreachBatch(jobs.logged_once(log)).option("checkpointLocation", state)
         .trigger(availableNow=True).start().awaitTermination())
    return storage.read_or_empty(v.spark, log, v.alerts.selectExpr("symbol", "date", "alert_type").schema).select("symbol", "date", "alert_type")


query("r04_exit_alerts", "alerts", f"""
WITH p AS (SELECT s_suppkey AS symbol, 50.0::DOUBLE AS entry, (s_suppkey % 20 + 1)::DOUBLE AS stop, (90 + s_suppkey % 20)::DOUBLE AS goal, TIMESTAMP '9999-01-01' AS until FROM supplier
 UNION ALL SELECT s_suppkey, 60.0, s_suppkey % 20 + 4, 85 + s_suppkey % 20, TIMESTAMP '2024-01-15' FROM supplier)
SELECT DISTINCT symbol, {DATE}, alert_type FROM (SELECT a.symbol, a.date, CASE WHEN price <= stop THEN 'stop_hit' WHEN (price - stop)/entry*100 < 2 THEN 'stop_approached'
 WHEN price >= goal THEN 'target_hit' WHEN (goal - price)/entry*100 < 2 THEN 'target_approached' WHEN price > 80 AND price < 88 THEN 'overextended_exit' END AS alert_type
 FROM alerts a JOIN p ON p.symbol = a.symbol AND a.ts <= p.until) WHERE alert_type IS NOT NULL""")(exits)


def appended(v: Views):
    """Daily closes appended batch by batch through the drift guard, twice."""
    path = place(v, "append")
    daily = v.alerts.groupBy(c("symbol").alias("isin"), "date").agg(
        F.max_by("price", F.struct("ts", "event_id")).alias("close"), F.lit(1.0).alias("adj_factor"))
    source = place(v, "append-source")
    daily.write.mode("overwrite").parquet(source)
    stream = v.spark.readStream.schema(daily.schema).option("maxFilesPerTrigger", 1).parquet(source)
    for run in ("a", "b"):
        (stream.writeStream.foreachBatch(jobs.guarded_append(f"{path}/table"))
         .option("checkpointLocation", f"{path}/state-{run}").trigger(availableNow=True).start().awaitTermination())
    return v.spark.read.parquet(f"{path}/table").select("isin", "date", "close")


query("r05_guarded_append", "alerts", f"SELECT symbol AS isin, {DATE}, {rnd('arg_max(price, {0})')} AS close FROM alerts GROUP BY 1, date".replace("{0}", "{'t': ts, 'e': event_id}"))(appended)


def expiry(v: Views):
    """Every tenth sign-up opens a watch entry; purchase days are the sessions, as they repeat in the events."""
    all_ = ticks(v)
    entries = all_.filter("alert_type = 'signup' AND event_id % 10 = 0").select("symbol", c("event_id").alias("entry_id"), c("date").alias("signal_date"))
    with jobs.keyed_state(v.spark):
        return jobs.drain(jobs.expired_watches(entries, ticks(v).filter("alert_type = 'purchase'").select("symbol", "date")), place(v, "expiry"))


query("r06_watch_expiry", "alerts", """
SELECT symbol, entry_id, CAST(signal_date AS VARCHAR) AS signal_date FROM (SELECT e.symbol, e.event_id AS entry_id, e.date AS signal_date, count(DISTINCT p.date) AS n
 FROM alerts e JOIN alerts p ON p.symbol = e.symbol AND p.alert_type = 'purchase' AND p.date > e.date WHERE e.alert_type = 'signup' AND e.event_id % 10 = 0 GROUP BY ALL) WHERE n > 8""")(expiry)


def staleness(v: Views):
    """Every source stops when the file ends; its timer raises the flag, and the lag is taken from the flagged time."""
    with jobs.keyed_state(v.spark):
        flags = jobs.watch_until_quiet(jobs.stale_sources(ticks(v), "alert_type", 1000), place(v, "stale"), 0.5)
    last = flags.filter("stale").select(c("source").alias("alert_type"), c("last_ts").alias("ts"))
    return jobs.staleness(last, F.lit("2024-01-31 00:00:00").cast("timestamp"), 1200)


query("r07_staleness", "alerts", "SELECT alert_type, CAST(floor(epoch(TIMESTAMP '2024-01-31 00:00:00')) - floor(epoch(max(ts))) AS BIGINT) AS lag_seconds, floor(epoch(TIMESTAMP '2024-01-31 00:00:00')) - floor(epoch(max(ts))) > 1200 AS stale FROM alerts GROUP BY 1")(staleness)
