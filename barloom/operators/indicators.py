"""Resampling, indicator panel, boolean signals and the 0-100 score."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import recur
from barloom.functions.windows import (
    bars_window,
    one_series,
    running_mean,
    sma,
    sure,
    trailing,
    with_rolling_extremes,
)

KEYS = ("timeframe", "symbol")


@dataclass(frozen=True)
class SignalConfig:
    """Thresholds and weights of the score; fixed values the results depend on."""

    rsi_min: float = 35.0
    rsi_max: float = 65.0
    min_adx: float = 20.0
    tier1_adx: float = 30.0
    score_threshold: float = 55.0
    min_signal_tier: int = 2
    require_consolidation: bool = True
    consolidation_bars: int = 15
    consolidation_pct: float = 12.0
    pullback_pct: float = 3.0
    rsi_overbought: float = 80.0
    recovery_bars: int = 5
    ema_weight: float = 28.5
    macd_weight: float = 21.5
    rsi_weight: float = 21.5
    volume_weight: float = 21.5
    trend_weight: float = 7.0
    ema200_weight: float = 7.0


def period_end(date: Column, freq: str) -> Column:
    """Last day of the bar a date falls into: W (Sunday), W-FRI, ME, QE."""
    if freq == "W":
        return F.next_day(F.date_sub(date, 1), "Sunday")
    if freq == "W-FRI":
        return F.next_day(F.date_sub(date, 1), "Friday")
    if freq == "ME":
        return F.last_day(date)
    if freq == "QE":
        return F.last_day(F.add_months(F.trunc(date, "quarter"), 2))
    raise ValueError(f"unknown frequency {freq!r}")


def resample_bars(bars: DataFrame, freq: str, drop_incomplete: bool = True) -> DataFrame:
    """Daily bars to period bars; the newest period of each symbol is not complete."""
    out = bars.groupBy("symbol", period_end(F.col("date"), freq).alias("date")).agg(
        F.min_by("open", "date").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "date").alias("close"),
        F.sum("volume").alias("volume"),
    )
    if not drop_incomplete:
        return out
    newest = F.max("date").over(Window.partitionBy("symbol"))
    return out.withColumn("_newest", newest).filter(F.col("date") < F.col("_newest")).drop("_newest")


def stack_timeframes(bars: DataFrame) -> DataFrame:
    """Daily, weekly and monthly bars in one long table keyed by timeframe."""
    cols = ["symbol", "date", "open", "high", "low", "close", "volume"]
    parts = [("D", bars), ("W", resample_bars(bars, "W")), ("M", resample_bars(bars, "ME"))]
    frames = [df.select(F.lit(tf).alias("timeframe"), *cols) for tf, df in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def newest_dates(bars: DataFrame) -> DataFrame:
    """Newest date of each timeframe."""
    return bars.groupBy("timeframe").agg(F.max("date").alias("date"))


def reaching_newest(bars: DataFrame, keys=KEYS, newest: DataFrame | None = None) -> DataFrame:
    """All bars of the keys that have one at the newest date of their timeframe: no other key has a row there."""
    whole = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = (newest_dates(bars) if newest is None else newest).select("timeframe", F.col("date").alias("_newest"))
    df = bars.withColumn("_last", F.max("date").over(whole)).join(F.broadcast(ends), "timeframe")
    return df.filter(F.col("_last") == F.col("_newest")).drop("_last", "_newest")


def true_range(w) -> Column:
    prev = F.lag("close").over(w)
    high, low = F.col("high"), F.col("low")
    return F.greatest(high - low, F.abs(high - prev), F.abs(low - prev))


def indicator_panel(bars: DataFrame, keys=KEYS, even: float | None = 1e-13) -> DataFrame:
    """EMAs, MACD, RSI, ATR, ADX and range levels for every bar of every key.

    EMAs and Wilder averages start from the plain mean of their first n inputs and
    are null before; RSI and ADX are in Wilder's form.  Average gain and loss whose difference
    is at most ``even`` of their sum give an RSI of exactly 50; with None it is the plain quotient,
    which last bits may put on either side.
    """
    bar, close = F.col(recur.BAR), F.col("close")
    spans = (("ema5", 5), ("_e12", 12), ("ema13", 13), ("ema21", 21), ("_e26", 26), ("ema200", 200))
    emas = [recur.ema_of(name, close, n, sma_seed=F.col("_sclose")) for name, n in spans]
    wilders = [
        recur.wilder_of(f"_w{c}", F.col(f"_{c}"), 14, F.col(f"_m{c}"), first=1)
        for c in ("gain", "loss", "pdm", "mdm")
    ]
    wilders += [
        recur.wilder_of("atr", F.col("_tr"), 14, F.col("_mtr")),
        recur.wilder_of("_wtr", F.col("_tr"), 14, F.col("_mtr1"), first=1),
    ]
    # The rows are sorted while they are narrow; every window from here on has that order.
    df = recur.number_blocks(recur.number_bars(bars, keys), emas + wilders)
    order = recur.time_order(df)
    w = bars_window(*keys, order=order)
    df = with_rolling_extremes(
        df,
        "close",
        {"week52_high": ("max", 252, 0), "week52_low": ("min", 252, 0), "resistance_level": ("max", 240, 20)},
        keys,
        order,
    )

    # At the bar where a recursion starts, all values so far are exactly its first n.
    def seed_of(x: Column) -> Column:
        return running_mean(x, keys, order)

    move = close - F.lag("close").over(w)
    up = F.col("high") - F.lag("high").over(w)
    down = F.lag("low").over(w) - F.col("low")
    df = df.withColumns(
        {
            "_gain": F.when(bar > 0, F.greatest(move, F.lit(0.0))),
            "_loss": F.when(bar > 0, F.greatest(-move, F.lit(0.0))),
            "_tr": true_range(w),
            "_pdm": F.when(bar > 0, F.when((up > down) & (up > 0), up).otherwise(0.0)),
            "_mdm": F.when(bar > 0, F.when((down > up) & (down > 0), down).otherwise(0.0)),
            "vol_sma20": sma(F.col("volume"), 20, keys, order),
        }
        | {
            f"momentum_{m}m": (close / F.lag("close", n).over(w) - 1) * 100
            for m, n in ((1, 21), (3, 63), (6, 126), (12, 252))
        }
    )
    seeds = {"_sclose": seed_of(close), "_mtr1": seed_of(F.when(bar > 0, F.col("_tr")))}
    seeds |= {f"_m{c}": seed_of(F.col(f"_{c}")) for c in ("gain", "loss", "tr", "pdm", "mdm")}
    df = df.withColumns(seeds)
    df = recur.solve(df, emas + wilders, keys)

    gain, loss = F.col("_wgain"), F.col("_wloss")
    rsi = F.when(gain + loss > 0, 100.0 * gain / (gain + loss))
    if even is not None:  # for the rules that ask for more than 50
        rsi = F.when((gain + loss > 0) & (F.abs(gain - loss) <= even * (gain + loss)), 50.0).otherwise(rsi)
    pdi, mdi = F.try_divide("_wpdm", "_wtr"), F.try_divide("_wmdm", "_wtr")  # null for a flat name
    df = df.withColumns(
        {
            "macd": F.col("_e12") - F.col("_e26"),
            "rsi": rsi,
            "_dx": F.when(bar >= 14, F.coalesce(F.try_divide(100.0 * F.abs(pdi - mdi), pdi + mdi), F.lit(0.0))),
        }
    )
    slope = (F.col("ema21") - F.lag("ema21", 5).over(w)) / 5.0
    df = df.withColumns({"_mmacd": seed_of(F.col("macd")), "_mdx": seed_of(F.col("_dx")), "ema_slope_21": slope})
    df = recur.solve(
        df,
        [
            recur.ema_of("macd_signal", F.col("macd"), 9, first=25, sma_seed=F.col("_mmacd")),
            recur.wilder_of("adx", F.col("_dx"), 14, F.col("_mdx"), first=14),
        ],
        keys,
    )
    keep = {recur.BAR, *recur.block_names(df)}
    return df.drop(*[c for c in df.columns if c.startswith("_") and c not in keep])


def boolean_signals(panel: DataFrame, cfg: SignalConfig = SignalConfig(), keys=KEYS) -> DataFrame:
    """Cross, pullback, MACD and trend flags (vectorised form, hard filters on daily bars)."""
    w = bars_window(*keys, order=recur.time_order(panel))
    c = F.col
    cross = (c("ema5") > c("ema13")) & (F.lag("ema5").over(w) <= F.lag("ema13").over(w))
    pull = (
        (c("ema5") > c("ema13"))
        & (c("close") > c("ema21"))
        & (F.abs(c("close") - c("ema21")) / c("ema21") < cfg.pullback_pct / 100.0)
    )
    df = panel.withColumns(
        {
            "signal_ema_cross": sure(cross),
            "signal_pullback_21": sure(pull),
            "signal_macd_bullish": sure(c("macd") > c("macd_signal")),
            "overextended": sure(c("rsi") > cfg.rsi_overbought),
        }
    )
    stacked = sure((c("ema5") > c("ema13")) & (c("ema13") > c("ema21")))
    trend = (c("signal_ema_cross") | c("signal_pullback_21") | stacked) & c("signal_macd_bullish")
    daily = (
        trend
        & (c("rsi") > cfg.rsi_min)
        & (c("rsi") <= cfg.rsi_max)
        & (c("close") > c("ema200"))
        & (c("adx") >= cfg.min_adx)
    )
    weekly = (c("rsi") > 50) & (c("close") > c("ema21"))
    monthly = (c("rsi") > 50) & ((c("close") > c("ema13")) | (c("close") > c("ema21")))
    tf = c("timeframe")
    bullish = F.when(tf == "D", daily).when(tf == "W", weekly).otherwise(monthly)
    return df.withColumn("bullish_flag", sure(bullish))


def is_consolidating(bars: int, max_pct: float, keys=KEYS, order: str | Sequence[str] = "date") -> Column:
    """Range of the preceding bars stays within max_pct; false on a short history."""
    prior = trailing(keys, bars, order, end=-1)
    high, low = F.max("high").over(prior), F.min("low").over(prior)
    return sure((F.col(recur.BAR) >= bars + 1) & (low > 0) & ((high - low) / low * 100 <= max_pct))


def score_signals(panel: DataFrame, cfg: SignalConfig = SignalConfig(), keys=KEYS) -> DataFrame:
    """Score every bar: sub-scores per component, labels, vetoes and the clamp to 0-100."""
    order = recur.time_order(panel)
    w = bars_window(*keys, order=order)
    c, bar, price = F.col, F.col(recur.BAR), F.col("close")
    daily = c("timeframe") == "D"
    df = panel.withColumns(
        {
            "above_200ema": price > c("ema200"),
            "pct_from_52w_high": (price / c("week52_high") - 1) * 100,
            "pct_from_52w_low": (price / c("week52_low") - 1) * 100,
            "pct_from_resistance": (price / c("resistance_level") - 1) * 100,
            "volume_breakout": sure(
                (c("vol_sma20") > 0) & (c("volume") > 2.0 * c("vol_sma20")) & (price > c("open"))
            ),
            "is_consolidating": daily & is_consolidating(cfg.consolidation_bars, cfg.consolidation_pct, keys, order),
            "price_change_pct": (price / F.lag("close").over(w) - 1) * 100,
            "_ready": bar >= F.when(c("timeframe") == "M", 23).otherwise(59),
            "_cross": sure((c("ema5") > c("ema13")) & (F.lag("ema5").over(w) <= F.lag("ema13").over(w))),
            "_pull": sure(
                (c("ema5") > c("ema13"))
                & (price > c("ema21"))
                & (F.abs(price - c("ema21")) / c("ema21") < cfg.pullback_pct / 100.0)
            ),
            "_stack": sure((c("ema5") > c("ema13")) & (c("ema13") > c("ema21"))),
            "_sink": sure((c("ema5") < c("ema13")) & (c("ema13") < c("ema21"))),
            "_mcross": sure(
                (c("macd") > c("macd_signal")) & (F.lag("macd").over(w) <= F.lag("macd_signal").over(w))
            ),
            "_mup": sure(c("macd") > c("macd_signal")),
            "_prsi": F.lag("rsi").over(w),
            "_oversold": sure(F.max((c("rsi") < 30).cast("int")).over(trailing(keys, cfg.recovery_bars, order)) == 1),
        }
    )
    live = c("_ready") & daily
    have_rsi = c("rsi").isNotNull() & c("_prsi").isNotNull()
    recovering = have_rsi & c("_oversold") & sure((c("rsi") > 30) & (price > c("ema21")))
    crossing = have_rsi & sure((c("_prsi") <= 50) & (c("rsi") > 50))
    df = df.withColumns(
        {
            "ema_signal": F.when(live & c("_cross"), "bullish_cross")
            .when(live & c("_pull"), "bullish_pullback")
            .when(live & c("_stack") & sure(price > c("ema21")), "bullish")
            .when(live & c("_sink"), "bearish")
            .otherwise("neutral"),
            "rsi_signal": F.when(live & recovering & c("_cross"), "bullish_recovery_confirmed")
            .when(live & recovering, "bullish_recovery")
            .when(live & crossing, "bullish_crossing")
            .when(live & have_rsi & sure((c("rsi") > 50) & (c("rsi") <= 65)), "bullish_strong")
            .when(live & have_rsi & sure((c("rsi") > 65) & (c("rsi") <= 68)), "bullish_extended")
            .otherwise("neutral"),
            "volume_signal": F.when(live & c("volume_breakout"), "bullish").otherwise("neutral"),
        }
    )
    adx_part = (
        F.when(c("adx") >= 35, 4.5).when(c("adx") >= 25, 3.0).when(c("adx") >= 20, 1.5).otherwise(0.0)
    )
    mom_part = F.when(c("momentum_3m") > 15, 3.0).when(c("momentum_3m") > 5, 1.5).otherwise(0.0)
    df = df.withColumns(
        {
            "pts_ema200": F.when(sure(c("above_200ema")), cfg.ema200_weight).otherwise(0.0),
            "pts_ema": cfg.ema_weight
            * F.when(c("ema_signal") == "bullish_cross", 1.0)
            .when(c("ema_signal") == "bullish_pullback", 21.5 / 28.5)
            .when(c("ema_signal") == "bullish", 11.5 / 28.5)
            .otherwise(0.0),
            "pts_macd": cfg.macd_weight
            * F.when(~live, 0.0)
            .when(c("_mcross") & c("_cross"), 11.5 / 21.5)
            .when(c("_mcross"), 1.0)
            .when(c("_mup") & (c("macd") > 0), 14.5 / 21.5)
            .when(c("_mup") & (c("macd") < 0), 7.0 / 21.5)
            .otherwise(0.0),
            "pts_rsi": cfg.rsi_weight
            * F.when(c("rsi_signal").startswith("bullish_recovery"), 1.0)
            .when(c("rsi_signal") == "bullish_crossing", 14.5 / 21.5)
            .when(c("rsi_signal") == "bullish_strong", 7.0 / 21.5)
            .otherwise(0.0),
            "pts_volume": F.when(c("volume_signal") == "bullish", cfg.volume_weight).otherwise(0.0),
            "pts_trend": F.when(
                live, F.least(cfg.trend_weight / 7.0 * (adx_part + mom_part), F.lit(cfg.trend_weight))
            ).otherwise(0.0),
            "_veto": sure(c("rsi") > cfg.rsi_max) | sure(price < c("ema200")) | sure(c("adx") < cfg.min_adx),
        }
    )
    total = (
        c("pts_ema200") + c("pts_ema") + c("pts_macd") + c("pts_rsi") + c("pts_volume") + c("pts_trend")
    )
    trend = (c("_cross") | c("_pull") | c("_stack")) & c("_mup") & sure(c("rsi") > cfg.rsi_min)
    slow = F.when(c("timeframe") == "W", (c("rsi") > 50) & (price > c("ema21"))).otherwise(
        (c("rsi") > 50) & ((price > c("ema13")) | (price > c("ema21")))
    )
    df = df.withColumns(
        {
            "is_bullish": c("_ready") & F.when(daily, trend & ~c("_veto")).otherwise(sure(slow)),
            "is_overextended": live & sure(c("rsi") > cfg.rsi_overbought),
        }
    )
    df = df.withColumns(
        {
            "ema_signal": F.when(c("_ready") & ~daily & c("is_bullish"), "bullish").otherwise(c("ema_signal")),
            "entry_score": F.when(~c("_ready"), c("pts_ema200"))
            .when(~daily, F.when(c("is_bullish"), 100.0).otherwise(0.0))
            .when(c("_veto"), 0.0)
            .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), total))),
        }
    )
    return df.drop(*[x for x in df.columns if x.startswith("_") and x != recur.BAR])


def rs_ranks(signals: DataFrame, parts: int | None = None) -> DataFrame:
    """Percentile position of each daily signal by 12-month momentum on its date.

    The index return is the same for every name of a date, so it moves no rank.  Only the
    ranked columns are dealt by date; the wide rows stay where their symbol is and meet the
    ranks by hash, a symbol's share of a task being small.  ``parts`` tasks rank the days (default:
    the session's shuffle partitions).  Ranks that ``signals`` may have from before are replaced.
    """
    ranked = signals.filter(F.col("momentum_12m").isNotNull() & (F.col("timeframe") == "D")).select("timeframe", "symbol", "date", "momentum_12m")
    if parts is not None:
        ranked = ranked.repartition(parts, "timeframe", "date")
    by = Window.partitionBy("timeframe", "date")
    pos = F.row_number().over(by.orderBy("momentum_12m", "symbol"))
    ranks = ranked.select("timeframe", "symbol", "date", (pos / F.count("*").over(by) * 100).alias("rs_score"))
    return signals.drop("rs_score").join(ranks.hint("shuffle_hash"), ["timeframe", "symbol", "date"], "left")


def rs_ranks_vs_index(signals: DataFrame, index: DataFrame, parts: int | None = None) -> DataFrame:
    """As :func:`rs_ranks`, with the excess over the index's own 252-bar return shown."""
    bench = index.select(
        "date",
        ((F.col("level") / F.lag("level", 251).over(one_series()) - 1) * 100).alias("index_12m"),
    )
    daily = signals.filter((F.col("timeframe") == "D") & F.col("momentum_12m").isNotNull())
    return rs_ranks(daily, parts).join(bench, "date", "left").withColumn(
        "excess_12m", F.col("momentum_12m") - F.col("index_12m")
    )
