"""Cross-sectional factors in long format: (date, isin, value); higher is better."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import recur
from barloom.functions.asof import asof_join
from barloom.functions.windows import (
    TRADING_DAYS,
    bars_window,
    one_series,
    pct_rank_avg,
    rolling_median,
    running,
    running_mean,
    skip_return,
    sma,
    sure,
    trailing,
    with_frame_sums,
)
from barloom.operators.indicators import period_end, true_range

c = F.col


@dataclass(frozen=True)
class FactorConfig:
    """Lookbacks in bars; fixed values the results depend on."""

    mom_lookback: int = 252
    mom_skip: int = 21
    mom6_lookback: int = 126
    mom6_skip: int = 21
    vol_lookback: int = 126
    trend_lookback: int = 126
    reversal_lookback: int = 21
    smoothing_months: int = 0


MONTH_BARS = 21


def ema(prices: DataFrame, span: int, keys: Sequence[str] = ("isin",), out: str = "ema") -> DataFrame:
    """EMA seeded by the first value."""
    df = recur.number_bars(prices, keys)
    return recur.solve(df, [recur.ema_of(out, c("close"), span)], keys).drop(recur.BAR)


def macd(prices: DataFrame, keys: Sequence[str] = ("isin",), fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """MACD line and signal from first-value-seeded EMAs."""
    df = recur.number_bars(prices, keys)
    df = recur.solve(df, [recur.ema_of("_f", c("close"), fast), recur.ema_of("_s", c("close"), slow)], keys)
    df = df.withColumn("macd", c("_f") - c("_s"))
    return recur.solve(df, [recur.ema_of("macd_signal", c("macd"), signal)], keys).drop("_f", "_s", recur.BAR)


def wilder_average(df: DataFrame, x: Column, n: int, keys: Sequence[str] = ("isin",), out: str = "rma") -> DataFrame:
    df = recur.number_bars(df, keys).withColumn("_x", x)
    df = df.withColumn("_seed", running_mean(c("_x"), keys))
    return recur.solve(df, [recur.wilder_of(out, c("_x"), n, c("_seed"))], keys).drop("_x", "_seed", recur.BAR)


def atr(prices: DataFrame, n: int = 20, keys: Sequence[str] = ("isin",)) -> DataFrame:
    """Wilder average of the true range; the first bar's range is high - low."""
    return wilder_average(prices, true_range(bars_window(*keys)), n, keys, "atr")


def weekly_macd(prices: DataFrame, **spans) -> DataFrame:
    """MACD line of completed weeks, carried to each daily date."""
    weekly = prices.groupBy("isin", period_end(c("date"), "W-FRI").alias("week_end")).agg(
        F.max_by("close", "date").alias("close")
    )
    line = macd(weekly.withColumnRenamed("week_end", "date"), **spans)
    line = line.select("isin", c("date").alias("week_end"), c("macd").alias("w_macd"))
    return asof_join(prices.select("isin", "date"), line, ["isin"], "date", "week_end", ["w_macd"], unique_left=True)


def gate_panel(prices: DataFrame, cfg: FactorConfig = FactorConfig()) -> DataFrame:
    """200-bar EMA, 12-1 momentum and annualised volatility per bar."""
    w = bars_window("isin")
    df = recur.number_bars(prices, ["isin"]).withColumns(
        {"_seed": running_mean(c("close"), ["isin"]), "_ret": c("close") / F.lag("close").over(w) - 1}
    )
    df = recur.solve(df, [recur.ema_of("ema200", c("close"), 200, sma_seed=c("_seed"))], ["isin"])
    total = cfg.mom_lookback + cfg.mom_skip
    df = with_volatility(df, cfg.vol_lookback, "annualized_vol")
    return df.withColumn("momentum_12_1", skip_return(c("close"), cfg.mom_skip, total, w)).drop("_seed", "_ret", recur.BAR)


def with_volatility(df: DataFrame, n: int, out: str) -> DataFrame:
    """Annualised sample deviation of the last n ``_ret`` values, from half a frame on."""
    df = with_frame_sums(df, {"_v1": (c("_ret"), n), "_v2": (c("_ret") * c("_ret"), n)}, ["isin"])
    k = c("_v1_n")
    var = F.greatest((c("_v2") - c("_v1") * c("_v1") / k) / (k - 1), F.lit(0.0))
    vol = F.when((k >= max(n // 2, 2)), F.sqrt(var) * F.sqrt(F.lit(float(TRADING_DAYS))))
    return df.withColumn(out, vol).drop("_v1", "_v2", "_v1_n", "_v2_n")


def entry_gate(floor: float, momentum_active: bool = True) -> Column:
    """Trend, liquidity and (when active) momentum; anything missing is a no."""
    ok = (c("close") > c("ema200")) & (c("adv_20") >= floor)
    return sure(ok & (c("momentum_12_1") > 0) if momentum_active else ok)


def ranker() -> Column:
    """Momentum per unit of volatility."""
    return F.when(c("annualized_vol") != 0, c("momentum_12_1") / c("annualized_vol"))


def eligible_ranked(panel: DataFrame, score: Column, gate: Column) -> DataFrame:
    df = panel.withColumn("score", score).filter(gate & c("score").isNotNull())
    order = Window.partitionBy("date").orderBy(c("score").desc(), "isin")
    return df.select("date", "isin", "score", F.row_number().over(order).alias("rank"))


def price_factors(prices: DataFrame, cfg: FactorConfig = FactorConfig()) -> DataFrame:
    """All price factors as columns, one pass over each instrument."""
    w = bars_window("isin")
    df = prices.select("isin", "date", "close", (c("close") / F.lag("close").over(w) - 1).alias("_ret"))
    df = with_volatility(df, cfg.vol_lookback, "_vol")
    up = F.when(c("_ret").isNotNull(), (c("_ret") > 0).cast("double"))
    df = with_frame_sums(df, {"_up": (up, cfg.trend_lookback)}, ["isin"])
    return df.select(
        "isin",
        "date",
        skip_return(c("close"), cfg.mom_skip, cfg.mom_lookback + cfg.mom_skip, w).alias("mom_12_1"),
        skip_return(c("close"), cfg.mom6_skip, cfg.mom6_lookback + cfg.mom6_skip, w).alias("mom_6_1"),
        (-c("_vol")).alias("low_vol"),
        F.when(c("_up_n") >= max(cfg.trend_lookback // 2, 1), c("_up") / c("_up_n")).alias("trend_quality"),
        (-skip_return(c("close"), 0, cfg.reversal_lookback, w)).alias("reversal"),
    )


PRICE_FACTORS = ("mom_12_1", "mom_6_1", "low_vol", "trend_quality", "reversal")


def long_factors(wide: DataFrame, names: Sequence[str]) -> DataFrame:
    return wide.unpivot(["isin", "date"], list(names), "factor", "value")


def resolve_weights(active: Sequence[str], weights: dict[str, float] | None = None) -> dict[str, float]:
    """Equal weights, or the given ones normalised; a missing or non-positive total raises."""
    if not active:
        raise ValueError("no active factors")
    if weights is None:
        return {n: 1.0 / len(active) for n in active}
    missing = [n for n in active if n not in weights]
    total = sum(weights[n] for n in active if n in weights)
    if missing or total <= 0:
        raise ValueError(f"factor weights: missing {missing}, total {total}")
    return {n: weights[n] / total for n in active}


def composite_rank(factors: DataFrame, names: Sequence[str], weights: dict[str, float] | None = None,
                   require_all: bool = True, smoothing_months: int = 0) -> DataFrame:
    """Blend of cross-sectional percentile ranks.

    ``factors`` is long (date, isin, factor, value), so every factor is ranked in one
    shuffle on (factor, date).  ``require_all`` drops a name when any factor is
    missing; otherwise the mean of those present counts.
    """
    w = resolve_weights(names, weights)
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in w.items() for x in kv]), c("factor"))
    ranked = factors.filter(c("factor").isin(*names)).select(
        "date", "isin", "factor", pct_rank_avg(c("value"), ["factor", "date"]).alias("r")
    )
    if require_all:
        full = F.count("r") == len(names)
        blend = F.when(full, F.sum(c("r") * weight))
    else:
        blend = F.avg("r")
    out = ranked.groupBy("date", "isin").agg(blend.alias("composite"))
    if smoothing_months:
        n = smoothing_months * MONTH_BARS
        out = out.withColumn("composite", F.avg("composite").over(trailing(["isin"], n)))
    return out


def value_rank(value_frames: DataFrame) -> DataFrame:
    """Mean of the percentile ranks of the value factors a name has on a date."""
    ranked = value_frames.select("date", "isin", pct_rank_avg(c("value"), ["factor", "date"]).alias("r"))
    return ranked.groupBy("date", "isin").agg(F.avg("r").alias("value_rank"))


def value_tilt(composite: DataFrame, ranks: DataFrame, lam: float) -> DataFrame:
    """Momentum rank plus lambda times the carried value rank; unknown value is neutral."""
    known = ranks.filter(c("value_rank").isNotNull()).withColumn("_vd", c("date"))
    seen = asof_join(composite, known, ["isin"], "date", "_vd", ["value_rank"], unique_left=True)
    return seen.withColumn("tilted", c("composite") + lam * F.coalesce("value_rank", F.lit(0.5)))


def factor_coverage(factors: DataFrame) -> DataFrame:
    """Share of names that have each factor on each date."""
    return factors.groupBy("date", "factor").agg((F.count("value") / F.count("*")).alias("coverage"))


def coverage_summary(coverage: DataFrame) -> DataFrame:
    return coverage.groupBy("factor").agg(
        F.avg("coverage").alias("mean"), F.min("coverage").alias("min"), F.max("coverage").alias("max")
    )


def spearman_by_date(pairs: DataFrame, a: str, b: str, min_pairs: int = 5) -> DataFrame:
    """Rank correlation of two measures across names, per date with enough pairs."""
    from barloom.functions.windows import avg_rank

    df = pairs.filter(c(a).isNotNull() & c(b).isNotNull())
    df = df.select("date", avg_rank(c(a), ["date"]).alias("ra"), avg_rank(c(b), ["date"]).alias("rb"))
    return df.groupBy("date").agg(F.count("*").alias("n"), F.corr("ra", "rb").alias("rho")).filter(c("n") >= min_pairs)


def block_mean(names: Sequence[str]) -> Column:
    """Mean over the factors that are present; null when none is."""
    kept = F.array_compact(F.array(*[c(n) for n in names]))
    total = F.aggregate(kept, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(kept) > 0, total / F.size(kept))


def pooled_corr(pairs: DataFrame, a: str, b: str) -> DataFrame:
    df = pairs.filter(c(a).isNotNull() & c(b).isNotNull())
    return df.agg(F.corr(a, b).alias("corr"), F.count("*").alias("n"))


def sparse_mean(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of sparse (date, isin, value) frames averaged per cell."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.groupBy("date", "isin").agg(F.avg("value").alias("value"))


def swing_signals(prices: DataFrame, selector_lookback: int = 126) -> DataFrame:
    """Entry (four conditions) and cross-down exit of the swing rules."""
    k, w = ["isin"], bars_window("isin")
    close = c("close")
    df = macd(prices)
    df = recur.solve(recur.number_bars(df, k), [recur.ema_of("ema_exit", close, 50)], k).drop(recur.BAR)
    df = with_frame_sums(atr(df, 20), {"_s50": (close, 50), "_s200": (close, 200)}, k)
    df = df.withColumns(
        {
            "sma_short": sma(close, 20, k),
            "sma_mid": F.when(c("_s50_n") == 50, c("_s50") / 50),
            "sma_long": F.when(c("_s200_n") == 200, c("_s200") / 200),
            "mom": close / F.lag("close", selector_lookback).over(w) - 1,
            "_pm": F.lag("macd").over(w),
            "_ps": F.lag("macd_signal").over(w),
        }
    ).join(weekly_macd(prices), ["isin", "date"])
    known = c("w_macd").isNotNull() & c("sma_long").isNotNull() & c("sma_mid").isNotNull() & c("macd").isNotNull()
    entry = (
        (c("w_macd") > 0)
        & (close > c("sma_long"))
        & (c("sma_short") > c("sma_mid"))
        & sure((c("macd") > c("macd_signal")) & (c("_pm") <= c("_ps")))
    )
    return df.withColumns(
        {
            "entry": F.when(known, entry),
            "exit_macd_cross_down": sure((c("macd") < c("macd_signal")) & (c("_pm") >= c("_ps"))),
        }
    ).drop("_pm", "_ps", "_s50", "_s200", "_s50_n", "_s200_n")


def stable_universe(prices: DataFrame, reviews: DataFrame, size: int, buffer: float, lookback: int = 126) -> DataFrame:
    """Membership per (review date, isin): enter at rank <= U, stay until rank > B*U.

    A name without a full window at a review is out, so its state spans only unbroken
    runs of reviews: no names-by-reviews grid is built.
    """
    numbered = reviews.withColumn("_k", F.row_number().over(one_series()))
    snap = review_medians(prices, reviews, lookback).join(F.broadcast(numbered), "date")
    snap = snap.withColumn("rank", F.row_number().over(Window.partitionBy("date").orderBy(c("liq").desc(), "isin")))
    run = c("_k") - F.row_number().over(bars_window("isin"))
    mark = F.when(c("rank") <= size, 1).when(c("rank") > buffer * size, 0)
    return (
        snap.withColumns({"_run": run, "_mark": mark})
        .withColumn("_in", F.coalesce(F.last("_mark", ignorenulls=True).over(running(["isin", "_run"])), F.lit(0)))
        .filter(c("_in") == 1)
        .select(c("date").alias("review"), "isin", "rank")
    )


def review_medians(prices: DataFrame, reviews: DataFrame, lookback: int) -> DataFrame:
    """Median of ``adv_20`` over a name's last ``lookback`` bars, at its review days with a full window only.

    Bars are numbered per name and meet the reviews through number blocks of ``lookback`` bars: a window
    lies in two blocks at most, so each bar goes only to the windows that hold it.
    """
    bars = prices.select("isin", "date", "adv_20", F.row_number().over(bars_window("isin")).alias("_bar"))
    at = bars.join(F.broadcast(reviews.select("date")), "date", "left_semi").filter(c("_bar") >= lookback)
    low = c("_bar") - lookback + 1
    blocks = F.array_distinct(F.array(F.floor(low / lookback), F.floor(c("_bar") / lookback)))
    windows = at.select("isin", c("date").alias("_review"), low.alias("_low"), c("_bar").alias("_high"), F.explode(blocks).alias("_block"))
    inside = (
        bars.select("isin", "adv_20", "_bar", F.floor(c("_bar") / lookback).alias("_block"))
        .join(windows, ["isin", "_block"])
        .filter(c("_bar").between(c("_low"), c("_high")) & c("adv_20").isNotNull())
    )
    out = inside.groupBy("isin", c("_review").alias("date")).agg(F.median("adv_20").alias("liq"), F.count("*").alias("_n"))
    return out.filter(c("_n") == lookback).select("isin", "date", "liq")


def universe_days(prices: DataFrame, reviews: DataFrame, members: DataFrame) -> DataFrame:
    """Price rows of names that were members at the last review on or before the day."""
    days = prices.select("date").distinct()
    last = asof_join(days, reviews.select(c("date").alias("review"), c("date").alias("_d")), [], "date", "_d", ["review"], unique_left=True)
    return (
        prices.select("isin", "date")
        .join(F.broadcast(last), "date")
        .join(members.select("review", "isin"), ["review", "isin"], "left_semi")
        .select("isin", "date")
    )
