"""Entry and exit alerts, digests and trade setups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.windows import sure
from barloom.operators.indicators import SignalConfig

c = F.col


def entry_status(close: Column, ema21: Column) -> Column:
    """in_zone / extended / chasing by distance above the 21-bar average."""
    pct = (close - ema21) / ema21 * 100
    bad = close.isNull() | ema21.isNull() | (close == 0) | (ema21 == 0)
    return F.when(bad, "unknown").when(pct <= 3, "in_zone").when(pct <= 8, "extended").otherwise("chasing")


def trade_setup(
    capital: float = 1e6,
    risk_pct: float = 3.0,
    atr_mult: float = 2.0,
    stop_loss_pct: float | None = 7.0,
    targets: Sequence[float] = (1.5, 2.5),
) -> Column:
    """Nested setup of a signal row: entry zone, stop, R targets and position size; null without risk."""
    price, atr, ema21, level = c("close"), c("atr"), c("ema21"), c("resistance_level")
    kind = (
        F.when(c("ema_signal") == "bullish_cross", "ema_crossover")
        .when((c("ema_signal") == "bullish_pullback") & ema21.isNotNull(), "pullback_to_ema21")
        .when(sure(level.isNotNull() & c("pct_from_resistance").between(-3, 0)), "resistance_breakout")
        .otherwise("trend_continuation")
    )
    zones = {
        "ema_crossover": (price * 0.995, price * 1.005),
        "pullback_to_ema21": (ema21 * 0.99, ema21 * 1.01),
        "resistance_breakout": (level * 1.002, level * 1.010),
        "trend_continuation": (price * 0.990, price * 1.010),
    }

    def side(i: int) -> Column:
        out = F.when(F.lit(False), F.lit(0.0))
        for name, pair in zones.items():
            out = out.when(kind == name, pair[i])
        return out

    low, high = side(0), side(1)
    mid = (low + high) / 2
    stop = mid - atr_mult * atr
    if stop_loss_pct is not None:
        stop = F.greatest(stop, mid * (1 - stop_loss_pct / 100))
    risk = mid - stop
    shares = F.floor(F.lit(capital * risk_pct / 100.0) / risk)
    goals = F.transform(
        F.array(*[F.lit(float(r)) for r in targets]),
        lambda r: F.struct(
            F.round(mid + r * risk, 2).alias("level"),
            r.alias("rr"),
            F.when(r == float(targets[0]), "partial").otherwise("primary").alias("label"),
        ),
    )
    setup = F.struct(
        kind.alias("setup_type"),
        F.round(low, 2).alias("entry_low"),
        F.round(high, 2).alias("entry_high"),
        F.round(stop, 2).alias("stop_loss"),
        goals.alias("targets"),
        F.round(atr, 2).alias("atr"),
        F.round(risk, 2).alias("risk_per_share"),
        shares.alias("shares"),
        F.round(shares * mid, 2).alias("position_value"),
        F.round(F.round(shares * mid, 2) / capital * 100, 1).alias("position_pct"),
    )
    return F.when(sure((price != 0) & (atr > 0) & (risk > 0)), setup)


def _entry_rules(cfg: SignalConfig) -> tuple[Column, Column]:
    """Whether a signal row is actionable, and its tier."""
    hit = (
        (c("timeframe") == "D")
        & c("ema_signal").isin("bullish_cross", "bullish_pullback")
        & c("above_200ema")
        & c("rsi").between(cfg.rsi_min, cfg.rsi_max)
        & (c("momentum_12m") > 0)
        & (c("entry_score") >= cfg.score_threshold)
    )
    if cfg.min_signal_tier == 1:
        hit = hit & c("volume_breakout") & (c("adx") >= cfg.tier1_adx)
    else:
        hit = hit & (c("volume_breakout") | (c("adx") >= cfg.min_adx))
    if cfg.require_consolidation:
        hit = hit & c("is_consolidating")
    adx = F.coalesce(c("adx"), F.lit(0.0))
    tier = (
        F.when(c("volume_breakout") & (adx >= cfg.tier1_adx), 1)
        .when(c("volume_breakout") | (adx >= cfg.min_adx), 2)
        .otherwise(3)
    )
    return hit, tier


def _entry_rows(df: DataFrame, stocks: DataFrame, tier: Column, *more: str) -> DataFrame:
    return df.join(stocks.select("symbol", "name", "sector"), "symbol").select(
        "date",
        "symbol",
        F.coalesce("sector", F.lit("Unknown")).alias("sector"),
        "entry_score",
        tier.alias("signal_tier"),
        entry_status(c("close"), c("ema21")).alias("entry_status"),
        ((c("close") - c("ema21")) / c("ema21") * 100).alias("pct_above_ema21"),
        *more,
    )


def entry_alerts(
    signals: DataFrame, stocks: DataFrame, cfg: SignalConfig = SignalConfig(), alerted: DataFrame | None = None
) -> DataFrame:
    """Actionable daily signals of every date with tier and entry status, minus those already sent."""
    hit, tier = _entry_rules(cfg)
    df = signals.filter(hit)
    if alerted is not None:
        df = df.join(alerted, ["symbol", "date"], "left_anti")
    return _entry_rows(df, stocks, tier)


def entry_alerts_of(signals: DataFrame, stocks: DataFrame, configs: dict[str, SignalConfig]) -> DataFrame:
    """:func:`entry_alerts` of several configs with their name as strategy_id, in one pass over the signals."""
    rules = {name: _entry_rules(cfg) for name, cfg in configs.items()}
    found = F.array_compact(
        F.array(
            *[
                F.when(sure(hit), F.struct(F.lit(name).alias("strategy_id"), tier.alias("_tier")))
                for name, (hit, tier) in rules.items()
            ]
        )
    )
    cols = ["date", "symbol", "entry_score", "close", "ema21"]
    daily = signals.filter(c("timeframe") == "D").select(*cols, F.inline(found))
    return _entry_rows(daily, stocks, c("_tier"), "strategy_id")


def best_alert_per_symbol(alerts: DataFrame) -> DataFrame:
    """Of the alerts of several configs, the one with the best tier, then score."""
    order = Window.partitionBy("date", "symbol").orderBy("signal_tier", c("entry_score").desc(), "strategy_id")
    return alerts.withColumn("_n", F.row_number().over(order)).filter(c("_n") == 1).drop("_n")


def signal_digest(signals: DataFrame, stocks: DataFrame, configs: dict[str, SignalConfig]) -> DataFrame:
    """Per symbol and date, the configs it satisfies, with the tier of the first of them.

    A config that asks for consolidation looks at its own number of bars and its own range: the highest
    high of the bars before, over the lowest low.  One window serves each distinct number of bars.
    """
    daily = signals.filter(c("timeframe") == "D")
    base = Window.partitionBy("symbol").orderBy("date")
    looked = sorted({cfg.consolidation_bars for cfg in configs.values() if cfg.require_consolidation})
    for n in looked:
        w = base.rowsBetween(-n, -1)
        full = F.count("low").over(w) == n
        swing = F.try_divide(F.max("high").over(w) - F.min("low").over(w), F.min("low").over(w)) * 100
        daily = daily.withColumn(f"_range{n}", F.when(full & (F.min("low").over(w) > 0), swing))

    def met(cfg: SignalConfig) -> Column:
        hit = c("rsi").between(cfg.rsi_min, cfg.rsi_max) & (c("entry_score") >= cfg.score_threshold)
        return sure(hit & (c(f"_range{cfg.consolidation_bars}") <= cfg.consolidation_pct) if cfg.require_consolidation else hit)

    flags = {name: met(cfg) for name, cfg in configs.items()}
    tags = F.array_compact(F.array(*[F.when(flag, F.lit(name)) for name, flag in flags.items()]))
    floor = F.coalesce(*[F.when(flags[name], F.lit(cfg.min_adx)) for name, cfg in configs.items()])
    tier = F.when(sure(c("volume_breakout")) & (F.coalesce(c("adx"), F.lit(0.0)) >= floor), 1).otherwise(2)
    return (
        daily.withColumns({"strategy_tags": tags, "tier": tier})
        .filter(c("above_200ema") & c("ema_signal").isin("bullish_cross", "bullish_pullback") & (F.size("strategy_tags") > 0))
        .join(stocks.select("symbol", "sector"), "symbol")
        .select("date", "symbol", "sector", "entry_score", "tier", "strategy_tags")
    )


def exit_alerts(positions: DataFrame, bars: DataFrame) -> DataFrame:
    """Ladder of exit conditions of open positions on given bars.

    ``bars`` has one row per symbol: (symbol, date, high, low, close, rsi, prev_low).
    """
    now, entry = c("close"), c("entry_price")
    to_stop = F.coalesce(F.try_divide(now - c("stop_loss"), entry) * 100, F.lit(999.0))
    to_target = F.coalesce(F.try_divide(c("target") - now, entry) * 100, F.lit(999.0))
    kind = (
        F.when(sure(c("low") <= c("stop_loss")), "stop_hit")
        .when(to_stop < 2, "stop_approached")
        .when(sure(c("high") >= c("target")), "target_hit")
        .when(to_target < 2, "target_approached")
        .when(sure((c("rsi") > 80) & (now < c("prev_low"))), "overextended_exit")
    )
    urgency = (
        F.when(kind.isin("stop_hit", "target_hit"), "critical")
        .when(kind.isin("stop_approached", "overextended_exit"), "high")
        .otherwise("medium")
    )
    return (
        positions.filter(c("status") == "open")
        .join(bars, "symbol")
        .select(
            "symbol",
            "trade_id",
            "date",
            kind.alias("alert_type"),
            urgency.alias("urgency"),
            (F.try_divide(now - entry, entry) * 100).alias("unrealised_pct"),
            F.datediff("date", "entry_date").alias("holding_days"),
        )
        .filter(c("alert_type").isNotNull())
    )


def unsent(alerts: DataFrame, log: DataFrame, day: str = "date") -> DataFrame:
    """One alert of each (symbol, day, type), of the position with the least id, where the log has none yet."""
    keys = ["symbol", day, "alert_type"]
    rest = [x for x in alerts.columns if x not in keys and x != "trade_id"]
    first = alerts.groupBy(*keys).agg(F.min_by(F.struct("trade_id", *rest), "trade_id").alias("_r")).select(*keys, "_r.*")
    return first.join(log.select(*keys).distinct(), keys, "left_anti").select(*alerts.columns)


def action_centre(positions: DataFrame, watch: DataFrame, prices: DataFrame) -> DataFrame:
    """Watch rows inside their zone and open trades within 1% of stop or target."""
    live = prices.select("symbol", c("close").alias("price"))
    entries = watch.join(live, "symbol").filter(
        c("price").between(c("planned_entry_low"), c("planned_entry_high"))
    ).select("symbol", "trade_id", F.lit("entry_candidate").alias("kind"), F.lit(None).cast("double").alias("dist_pct"))
    held = positions.filter(c("status") == "open").join(live, "symbol")
    stop = (c("price") - c("stop_loss")) / c("stop_loss") * 100
    goal = (c("target") - c("price")) / c("price") * 100
    risks = held.select(
        "symbol",
        "trade_id",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(stop <= 1, F.struct(F.lit("sl_risk").alias("kind"), stop.alias("dist_pct"))),
                    F.when(goal <= 1, F.struct(F.lit("target_near").alias("kind"), goal.alias("dist_pct"))),
                )
            )
        ).alias("r"),
    ).select("symbol", "trade_id", "r.kind", "r.dist_pct")
    return entries.unionByName(risks)


def watch_metrics(watch: DataFrame, bars: DataFrame, latest: DataFrame, max_sessions: int = 8) -> DataFrame:
    """Sessions since the signal, distance to the 21-bar average, zone and expiry.

    Sessions after a day = bars of the symbol minus its bar number on that day, so
    the lookup is one equi-join per watch row and no pairing of days.
    ``bars`` has (symbol, date, bar); ``latest`` one row per symbol.
    """
    at = bars.select("symbol", c("date").alias("signal_date"), c("bar").alias("_at"))
    last = latest.select("symbol", c("bar").alias("_last"), c("close").alias("current_price"), "ema21")
    sessions = c("_last") - c("_at")
    return watch.join(at, ["symbol", "signal_date"]).join(last, "symbol").select(
        "symbol",
        "trade_id",
        sessions.alias("days_elapsed"),
        "current_price",
        F.coalesce((c("current_price") - c("ema21")) / c("ema21") * 100, F.lit(0.0)).alias("vs_ema21_pct"),
        sure(c("current_price").between(c("planned_entry_low"), c("planned_entry_high"))).alias("in_zone"),
        F.when(sessions > max_sessions, "expired").otherwise("watching").alias("status"),
    )
