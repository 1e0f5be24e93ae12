"""Result pages, reports and change lists over the signals table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.windows import bars_window, one_series
from barloom.operators.indicators import newest_dates
from barloom.sources import storage

c = F.col


def _bullish_count():
    return F.sum(F.when(c("is_bullish"), 1).otherwise(0))


def confluence_counts(signals: DataFrame, newest: DataFrame | None = None) -> DataFrame:
    """Bullish timeframes per symbol at the newest date of each timeframe (``newest``, default: those of the signals)."""
    newest = newest_dates(signals) if newest is None else newest
    return (
        signals.join(F.broadcast(newest), ["timeframe", "date"], "left_semi")
        .groupBy("symbol")
        .agg(_bullish_count().alias("confluence_count"))
    )


def result_page(
    signals: DataFrame,
    stocks: DataFrame,
    sort_by: str = "confluence",
    sectors: Sequence[str] | None = None,
    min_confluence: int | None = None,
    exact_confluence: int | None = None,
    symbols: Sequence | None = None,
    offset: int = 0,
    limit: int = 50,
    newest: DataFrame | None = None,
) -> DataFrame:
    """Filtered, ordered page of stocks with the total; the symbol breaks ties.

    One pass over the rows of each timeframe's newest date (``newest``, default: those of the signals) gives the
    confluence and the daily row, one for a symbol.  Those few rows are stored, since page and total both read them.
    """
    newest = newest_dates(signals) if newest is None else newest
    rows = signals.join(F.broadcast(newest), ["timeframe", "date"], "left_semi")
    rows = storage.cut_lineage(rows.select("timeframe", "symbol", "is_bullish", "entry_score", "rsi"))
    daily = {name: F.max(F.when(c("timeframe") == "D", c(name))).alias(name) for name in ("is_bullish", "entry_score", "rsi")}
    df = stocks.join(rows.groupBy("symbol").agg(_bullish_count().alias("confluence_count"), *daily.values()), "symbol")
    if sectors is not None:
        df = df.filter(c("sector").isin(*sectors))
    if exact_confluence is not None:
        df = df.filter(c("confluence_count") == exact_confluence)
    if min_confluence is not None:
        df = df.filter(c("confluence_count") >= min_confluence)
    if symbols is not None:
        df = df.filter(c("symbol").isin(*symbols))
    total = df.agg(F.count("*")).scalar()
    zero = F.lit(0.0)
    orders = {
        "score": [F.coalesce("entry_score", zero).desc()],
        "rsi": [F.coalesce("rsi", zero).desc()],
        "confluence": [
            c("confluence_count").desc(),
            F.coalesce("is_bullish", F.lit(False)).desc(),
            F.coalesce("entry_score", zero).desc(),
        ],
    }
    return (
        df.withColumns({"total": total, "has_more": total > offset + limit})
        .orderBy(*orders[sort_by], "symbol")
        .offset(offset)
        .limit(limit)
        .select("symbol", "sector", "confluence_count", "entry_score", "rsi", "total", "has_more")
    )


def daily_report(signals: DataFrame, stocks: DataFrame, top: int = 20) -> DataFrame:
    """Best names of each calendar date: confluence on that date's rows, score, RSI."""
    d = c("timeframe") == "D"
    df = (
        signals.join(stocks.select("symbol", "name"), "symbol")
        .groupBy("date", "symbol", "name")
        .agg(
            _bullish_count().alias("confluence_count"),
            F.max(F.when(d, c("entry_score")).otherwise(0.0)).alias("daily_score"),
            F.max(F.when(d, c("rsi")).otherwise(0.0)).alias("rsi"),
        )
    )
    order = Window.partitionBy("date").orderBy(c("confluence_count").desc(), c("daily_score").desc(), "symbol")
    return df.withColumn("place", F.row_number().over(order)).filter(c("place") <= top)


def signal_changes(signals: DataFrame) -> DataFrame:
    """Bullish flips and confluence moves of every symbol between consecutive daily dates.

    Each market date is compared with the market date just before it; symbols absent
    from either drop out.  Weekly and monthly rows count on their own date only.
    """
    tf = c("timeframe")
    per_day = signals.groupBy("symbol", "date").agg(
        _bullish_count().alias("conf"),
        F.max(F.when(tf == "D", c("is_bullish"))).alias("bull"),
        F.max(F.when(tf == "D", c("entry_score"))).alias("score"),
        F.max(F.when(tf == "D", c("close"))).alias("close_price"),
        F.max(F.when(tf == "D", c("price_change_pct"))).alias("price_change_pct"),
    )
    calendar = signals.filter(tf == "D").select("date").distinct()
    calendar = calendar.withColumn("prev_date", F.lag("date").over(one_series()))
    w = bars_window("symbol")  # over market dates, so the row before is the market date before or the symbol was absent
    before = {"_before": F.lag("date"), "p_conf": F.lag("conf"), "p_bull": F.lag("bull"), "prev_score": F.lag("score")}
    now, was = F.coalesce("bull", F.lit(False)), F.coalesce("p_bull", F.lit(False))
    kind = (
        F.when(~was & now, "newly_bullish")
        .when(was & ~now, "turned_bearish")
        .when(c("conf") > c("p_conf"), "confluence_improved")
        .when(c("conf") < c("p_conf"), "confluence_dropped")
    )
    return (
        per_day.join(F.broadcast(calendar), "date")
        .withColumns({name: value.over(w) for name, value in before.items()})
        .filter(c("_before") == c("prev_date"))
        .withColumn("change_type", kind)
        .filter(c("change_type").isNotNull())
        .select("date", "prev_date", "symbol", "change_type", "prev_score", c("score").alias("curr_score"), "close_price", "price_change_pct")
    )


def top_changes(changes: DataFrame, per_side: int = 10) -> DataFrame:
    up = c("change_type").isin("newly_bullish", "confluence_improved")
    order = Window.partitionBy("date", up).orderBy(F.coalesce("curr_score", F.lit(0.0)).desc(), "symbol")
    return changes.withColumn("_n", F.row_number().over(order)).filter(c("_n") <= per_side).drop("_n")


def latest_per_timeframe(signals: DataFrame) -> DataFrame:
    """Newest signal of each symbol and timeframe."""
    payload = F.struct("date", "entry_score", "ema_signal", "rsi", "rsi_signal", "adx", "rs_score")
    return (
        signals.groupBy("symbol", "timeframe").agg(F.max_by(payload, "date").alias("s")).select("symbol", "timeframe", "s.*")
    )


def score_history(signals: DataFrame, n: int | None = None) -> DataFrame:
    """Daily scores of each symbol: all, or the newest ``n``."""
    df = signals.filter(c("timeframe") == "D")
    if n is not None:
        w = Window.partitionBy("symbol").orderBy(c("date").desc())
        df = df.withColumn("_n", F.row_number().over(w)).filter(c("_n") <= n)
    return df.select("symbol", "date", "entry_score")


def day_change(bars: DataFrame) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("date")
    return bars.select(
        "symbol", "date", "close", ((c("close") / F.lag("close").over(w) - 1) * 100).alias("price_change_pct")
    )
