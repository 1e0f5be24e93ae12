"""Market breadth, internals and regime series."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import recur
from barloom.functions.asof import asof_join
from barloom.functions.windows import carry_forward, one_series, running_mean, sure

c = F.col


@dataclass(frozen=True)
class RegimeConfig:
    """Fixed values of the regime rules."""

    dma_period: int = 200
    dma_short: int = 50
    debounce_days: int = 3
    risk_off_floor: float = 0.0
    breadth_min: float = 60.0
    ad_min: float = 1.0
    vix_max: float = 20.0
    neutral_fraction: float = 0.5
    bear_rsi: float = 45.0
    bull_rsi: float = 60.0
    adx_threshold: float = 20.0
    adx_floor: float = 15.0
    breadth_low: float = 40.0
    breadth_high: float = 60.0
    confirmation_days: int = 5


def ad_ratio(up: Column, down: Column) -> Column:
    return up / F.when(down > 0, down).otherwise(1)


def breadth_pct(up: Column, down: Column) -> Column:
    return F.when(up + down > 0, up / (up + down) * 100)


def market_internals(prices: DataFrame, liquid_floor: float) -> DataFrame:
    """Advancers and decliners per day, all and liquid.

    A name counts only when it also traded on the market day just before.
    """
    days = prices.select("date").distinct().withColumn("_ord", F.row_number().over(one_series()))
    w = Window.partitionBy("isin").orderBy("date")
    df = prices.join(days, "date").select(
        "date",
        "adv_20",
        F.when(c("_ord") - F.lag("_ord").over(w) == 1, c("close") - F.lag("close").over(w)).alias("delta"),
    )
    liquid = c("adv_20") >= liquid_floor

    def n(cond: Column) -> Column:
        return F.sum(sure(cond).cast("long"))

    out = df.groupBy("date").agg(
        n(c("delta") > 0).alias("advancers"),
        n(c("delta") < 0).alias("decliners"),
        n(c("delta") == 0).alias("unchanged"),
        F.count("delta").alias("total"),
        n((c("delta") > 0) & liquid).alias("liq_advancers"),
        n((c("delta") < 0) & liquid).alias("liq_decliners"),
        n(c("delta").isNotNull() & liquid).alias("liq_total"),
    )
    return out.withColumns(
        {
            "breadth_pct": breadth_pct(c("advancers"), c("decliners")),
            "ad_ratio": ad_ratio(c("advancers"), c("decliners")),
            "liq_breadth_pct": breadth_pct(c("liq_advancers"), c("liq_decliners")),
            "liq_ad_ratio": ad_ratio(c("liq_advancers"), c("liq_decliners")),
        }
    )


def with_volatility(internals: DataFrame, vix: DataFrame) -> DataFrame:
    """Volatility joined on the day, gaps left null."""
    return internals.join(vix.select("date", "vix"), "date", "left")


def ema_breadth(panel: DataFrame) -> DataFrame:
    """Share of warmed-up names above their 200-bar EMA, per day."""
    warm = panel.filter(c("ema200").isNotNull())
    return warm.groupBy("date").agg(
        (F.avg((c("close") > c("ema200")).cast("double")) * 100).alias("breadth_pct"), F.count("*").alias("stock_count")
    )


def top_cap_breadth(panel: DataFrame, stocks: DataFrame, n: int = 500) -> DataFrame:
    """As :func:`ema_breadth`, over the n largest companies."""
    top = stocks.filter(c("market_cap").isNotNull()).orderBy(c("market_cap").desc(), "symbol").limit(n)
    return ema_breadth(panel.join(top.select("symbol"), "symbol", "left_semi"))


def _sma(x: str, n: int) -> Column:
    w = one_series().rowsBetween(1 - n, 0)
    return F.when(F.count(x).over(w) == n, F.avg(x).over(w))


def debounced_fraction(index: DataFrame, cfg: RegimeConfig = RegimeConfig()) -> DataFrame:
    """Risk-on until d days in a row close at or below the average, and back.

    The set and reset marks exclude each other, so carrying the last one forward is
    the exact state machine.
    """
    d = cfg.debounce_days
    dma = _sma("level", cfg.dma_period)
    df = index.withColumn("_above", F.when(dma.isNull(), 1).otherwise((c("level") > dma).cast("int")))
    w = one_series().rowsBetween(1 - d, 0)
    full = F.count("_above").over(w) == d
    mark = F.when(full & (F.min("_above").over(w) == 1), 1.0).when(full & (F.max("_above").over(w) == 0), cfg.risk_off_floor)
    df = df.withColumn("_mark", mark)
    run = one_series().rowsBetween(Window.unboundedPreceding, 0)
    return df.select("date", carry_forward(c("_mark"), run, F.lit(1.0)).alias("fraction"))


def regime_score(index: DataFrame, internals: DataFrame, cfg: RegimeConfig = RegimeConfig(), factors: int = 5) -> DataFrame:
    """0-5 (or 0-3) conditions met per market day and the deployable fraction."""
    levels = index.select("date", "level", _sma("level", cfg.dma_period).alias("dl"), _sma("level", cfg.dma_short).alias("ds"))
    df = asof_join(internals, levels.withColumn("_d", c("date")), [], "date", "_d", ["level", "dl", "ds"], unique_left=True)
    conds = [c("level") > c("dl"), c("ds") > c("dl"), c("liq_breadth_pct") > cfg.breadth_min]
    if factors == 5:
        conds += [c("liq_ad_ratio") > cfg.ad_min, c("vix") < cfg.vix_max]
    elif factors != 3:
        raise ValueError("factors must be 3 or 5")
    score = sum(sure(x).cast("int") for x in conds)
    low, high = (1, 4) if factors == 5 else (0, 3)
    frac = F.when(c("score") <= low, 0.0).when(c("score") >= high, 1.0).otherwise(cfg.neutral_fraction)
    return df.withColumn("score", score).select("date", "score", frac.alias("fraction"))


def timer_fraction(index: DataFrame, calendar: DataFrame, n: int = 200) -> DataFrame:
    """1 when the level is above its n-day average, else 0, carried to the calendar."""
    levels = index.select(c("date").alias("_d"), "level", _sma("level", n).alias("dma"))
    df = asof_join(calendar, levels, [], "date", "_d", ["level", "dma"], unique_left=True)
    return df.select("date", sure(c("level") > c("dma")).cast("double").alias("fraction"))


def linear_ramp(scores: DataFrame) -> DataFrame:
    return scores.select("date", (c("score") / 5.0).alias("fraction"))


def three_state(panel: DataFrame, breadth: DataFrame, cfg: RegimeConfig = RegimeConfig()) -> DataFrame:
    """Bear 0 / neutral 1 / bull 2 with a sticky bull and n-day confirmation.

    The wanted state depends on the current one, so each index series is walked in
    order; a series has one row per day, and series run in parallel.
    """
    rows = panel.join(breadth.select("date", "breadth_pct"), "date", "left").select(
        "symbol",
        "date",
        F.coalesce("rsi", F.lit(50.0)).alias("rsi"),
        F.coalesce("adx", F.lit(0.0)).alias("adx"),
        (c("close") < F.coalesce("ema200", F.lit(0.0))).alias("below"),
        F.coalesce("breadth_pct", F.lit(100.0)).alias("breadth"),
    )
    # What a day asks for: a fixed state, or 1 unless a bull run may continue (code 3).
    weak = F.when(c("breadth") > cfg.breadth_high, 2).when(c("breadth") < cfg.breadth_low, 0)
    strong = F.when((c("rsi") > cfg.bull_rsi) & (c("adx") > cfg.adx_threshold), 2)
    ask = (
        F.when(c("below") | (c("rsi") < cfg.bear_rsi), 0)
        .otherwise(F.coalesce(F.when(c("adx") < cfg.adx_floor, weak).otherwise(strong), F.when(c("rsi") >= 50, 3).otherwise(1)))
    )
    asked = rows.select("symbol", "date", ask.cast("int").alias("ask"))
    need = cfg.confirmation_days

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        state, streak, out = 1, 0, []
        for want in pdf["ask"]:
            if want == 3:
                want = 2 if state == 2 else 1
            streak = streak + 1 if want != state else 0
            if streak >= need:
                state, streak = want, 0
            out.append(state)
        return pd.DataFrame({"symbol": pdf["symbol"], "date": pdf["date"], "regime": out})

    return asked.groupBy("symbol").applyInPandas(walk, "symbol long, date date, regime int")


def index_trend(index: DataFrame) -> DataFrame:
    """Newest state of the index: above its 50 and 200 EMA with the 50 above the 200."""
    df = recur.number_bars(index.withColumn("k", F.lit(0)), ["k"])
    df = df.withColumn("_seed", running_mean(c("level"), ["k"]))
    df = recur.solve(df, [recur.ema_of(f"e{n}", c("level"), n, sma_seed=c("_seed")) for n in (50, 200)], ["k"])
    up = (c("level") > c("e50")) & (c("level") > c("e200")) & (c("e50") > c("e200"))
    return df.agg(F.coalesce(F.max_by(up, "date"), F.lit(True)).alias("bullish"))


def bullish_on(days: DataFrame, index_signals: DataFrame) -> DataFrame:
    """Newest index signal at or before each day; bullish when there is none."""
    sig = index_signals.select(c("date").alias("_d"), "is_bullish")
    return asof_join(days, sig, [], "date", "_d", ["is_bullish"], unique_left=True).select(
        "date", F.coalesce("is_bullish", F.lit(True)).alias("bullish")
    )


def timeframe_state(bars: DataFrame, slow: DataFrame) -> DataFrame:
    """State of the last completed slow bar at each daily bar; none before the first.

    A symbol without any slow bar passes.
    """
    state = slow.select("symbol", c("date").alias("_d"), c("is_bullish").alias("state"))
    got = asof_join(bars.select("symbol", "date"), state, ["symbol"], "date", "_d", ["state"], unique_left=True)
    known = slow.select("symbol").distinct().withColumn("_has", F.lit(True))
    return got.join(known, "symbol", "left").select(
        "symbol", "date", F.when(c("_has"), sure(c("state"))).otherwise(True).alias("confirmed")
    )


def align_benchmark(index: DataFrame, calendar: DataFrame, start, capital: float) -> DataFrame:
    """Index carried onto a calendar from a start date and rebased to capital; raises when it starts later."""
    days = calendar.filter(c("date") >= F.lit(start).cast("date"))
    df = asof_join(days, index.select(c("date").alias("_d"), "level"), [], "date", "_d", ["level"], unique_left=True)
    w = one_series().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.first("level").over(w)
    base = F.when(first.isNull(), F.raise_error(F.lit("benchmark starts after the window")).cast("double")).otherwise(first)
    return df.withColumn("_b", base).select("date", (c("level") / c("_b") * capital).alias("level"))


def regime_profile(fractions: DataFrame, rebalance: DataFrame) -> DataFrame:
    """Transitions, share of risk-off days and flips seen at rebalance dates."""
    def flips(df: DataFrame) -> DataFrame:
        return df.withColumn("_f", sure(c("fraction") != F.lag("fraction").over(one_series())).cast("long"))

    daily = flips(fractions)
    at = flips(fractions.join(rebalance.select("date"), "date", "left_semi")).agg(F.sum("_f")).scalar()
    return daily.agg(
        F.sum("_f").alias("transitions"), (F.avg((c("fraction") < 1).cast("double")) * 100).alias("risk_off_pct")
    ).withColumn("rebalance_flips", at)


def sleeve_nav(fractions: DataFrame, levels: DataFrame, defensive_growth: float, cost_rate: float) -> DataFrame:
    """NAV of an index/defensive mix that resets only when the lagged fraction changes.

    Inside a run of one fraction both legs just grow, so a run's NAV is a weighted sum
    of growth ratios; runs chain by a running product.  Switching costs are
    proportional to the traded share.
    """
    run_all = one_series().rowsBetween(Window.unboundedPreceding, 0)
    df = levels.join(fractions, "date").select("date", "level", F.lag("fraction").over(one_series()).alias("w"))
    df = df.withColumn("w", F.coalesce("w", F.lit(0.0)))
    df = df.withColumns(
        {
            "_r": F.coalesce(c("level") / F.lag("level").over(one_series()), F.lit(1.0)),
            "_c": F.when(F.lag("level").over(one_series()).isNull(), 1.0).otherwise(1.0 + defensive_growth),
            "_new": sure(c("w") != F.lag("w").over(one_series())).cast("int"),
        }
    ).withColumn("_run", F.sum("_new").over(run_all))
    inside = Window.partitionBy("_run").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns(
        {"_gr": F.exp(F.sum(F.log("_r")).over(inside)), "_gc": F.exp(F.sum(F.log("_c")).over(inside))}
    )
    df = df.withColumn("_grow", c("w") * c("_gr") + (1 - c("w")) * c("_gc"))
    ends = df.groupBy("_run").agg(
        F.max_by("_grow", "date").alias("_end"), F.max_by(c("w") * c("_gr") / c("_grow"), "date").alias("_drift"), F.first("w").alias("_w")
    )
    order = Window.partitionBy(F.lit(0)).orderBy("_run")
    traded = F.abs(c("_w") - F.coalesce(F.lag("_drift").over(order), F.lit(0.0)))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_keep", 1 - cost_rate * traded)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    start = F.exp(F.coalesce(F.sum(F.log("_end")).over(before), F.lit(0.0)) + F.sum(F.log("_keep")).over(upto))
    starts = ends.select("_run", start.alias("_start"))
    return df.join(F.broadcast(starts), "_run").select("date", "w", (c("_start") * c("_grow")).alias("nav"))
