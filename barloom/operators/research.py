"""Signal research: candidate sieves, score parts, screen-driven dates, fold statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.windows import sure
from barloom.operators.indicators import SignalConfig

c = F.col
WARMUP_BARS = 260


def entry_candidates(
    signals: DataFrame, cfg: SignalConfig = SignalConfig(), date_from=None, date_to=None, max_pct_from_52w_high: float = 0.0
) -> DataFrame:
    """Bars that pass the hard filters after warm-up, damped when not consolidating.

    A negative ``max_pct_from_52w_high`` keeps bars no further below their 52-week high than that.
    """
    keep = (
        (c("bar") >= WARMUP_BARS if "bar" in signals.columns else c("_bar") >= WARMUP_BARS)
        & c("ema_signal").isin("bullish_cross", "bullish_pullback", "bullish")
        & (c("close") > c("ema200"))
        & (c("momentum_12m") > 0)
        & (c("adx") >= cfg.min_adx)
        & (c("macd") > c("macd_signal"))
        & c("rsi").between(cfg.rsi_min, cfg.rsi_max)
        & (c("entry_score") > 0)
    )
    if max_pct_from_52w_high < 0:
        high = c("week52_high")
        away = F.when(high > 0, F.try_divide(c("close"), high) * 100 - 100).when(high.isNotNull(), 0.0)
        keep = keep & (away >= max_pct_from_52w_high)
    if date_from is not None:
        keep = keep & (c("date") >= date_from)
    if date_to is not None:
        keep = keep & (c("date") <= date_to)
    damp = F.lit(1.0) if cfg.require_consolidation else F.when(c("is_consolidating"), 1.0).otherwise(0.85)
    return (
        signals.filter(c("timeframe") == "D")  # alone, so that slower bars are left out before any window
        .filter(sure(keep))
        .select("date", "symbol", (c("entry_score") * damp).alias("score"))
        .filter(c("score") >= cfg.score_threshold)
    )


# The components of a score and what each can earn.
SCORE_PARTS = {"ema200": 7.0, "ema": 28.5, "macd": 21.5, "rsi": 21.5, "volume": 21.5, "trend": 7.0}


def score_breakdown(signals: DataFrame) -> DataFrame:
    """One row per component with the points earned and possible."""
    parts = F.array(
        *[
            F.struct(F.lit(k).alias("label"), c(f"pts_{k}").alias("earned"), F.lit(m).alias("maximum"))
            for k, m in SCORE_PARTS.items()
        ]
    )
    return signals.select("date", "symbol", F.inline(parts))
