"""Live-book analytics: costs, turnover, rebalances, positions, plans, scorecard."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import scan
from barloom.functions.windows import TRADING_DAYS, one_series, sure

c = F.col


@dataclass(frozen=True)
class CostConfig:
    """Per-fill charges and slippage; fixed values the results depend on."""

    stt: float = 0.001
    exchange: float = 0.0000297
    sebi: float = 0.000001
    stamp: float = 0.00015
    gst: float = 0.18
    dp_charge: float = 15.34
    base_slippage: float = 0.0015
    impact: float = 0.15
    participation_cap: float = 0.10
    flat_round_trip_bps: float | None = None

    @classmethod
    def optimistic(cls) -> CostConfig:
        return cls(base_slippage=0.0, impact=0.0)

    @classmethod
    def pessimistic(cls) -> CostConfig:
        return cls(base_slippage=0.003, impact=0.30)


def fill_cost(side: Column, qty: Column, price: Column, cfg: CostConfig = CostConfig()) -> Column:
    """Statutory charges of one fill; stamp on buys, depository charge on sells and trims."""
    value = qty * price
    if cfg.flat_round_trip_bps is not None:
        return value * (cfg.flat_round_trip_bps / 2 / 10_000)
    venue = value * (cfg.exchange + cfg.sebi)
    return (
        value * cfg.stt
        + venue * (1 + cfg.gst)
        + F.when(side == "buy", value * cfg.stamp).otherwise(0.0)
        + F.when(side.isin("sell", "trim"), cfg.dp_charge).otherwise(0.0)
    )


def effective_price(side: Column, price: Column, qty: Column, adv: Column, cfg: CostConfig = CostConfig()) -> Column:
    """Price after slippage that grows with participation up to a cap."""
    if cfg.flat_round_trip_bps is not None:
        return price
    share = F.least(qty * price / adv, F.lit(cfg.participation_cap))
    slip = F.when(sure(adv > 0), cfg.base_slippage + cfg.impact * share).otherwise(cfg.base_slippage)
    return price * F.when(side == "buy", 1 + slip).otherwise(1 - slip)


def modelled_cost(side: Column, qty: Column, price: Column, cfg: CostConfig) -> Column:
    """Charges plus slippage at the unknown-liquidity floor."""
    return fill_cost(side, qty, price, cfg) + F.abs(effective_price(side, price, qty, F.lit(0.0), cfg) - price) * qty


# Fixed value: which reason names a day's event when several occur.
REASON_ORDER = ("rebalance", "catastrophic_stop", "force_exit")


def headline(reason: Column) -> Column:
    rank = F.lit(len(REASON_ORDER))
    for i, name in reversed(list(enumerate(REASON_ORDER))):
        rank = F.when(reason == name, i).otherwise(rank)
    return F.element_at(F.array(*[F.lit(r) for r in (*REASON_ORDER, "force_exit")]), F.min(rank) + 1)


def cost_ledger(fills: DataFrame) -> DataFrame:
    """Realised against modelled cost per decision date and in total.

    fills: (decision_date, side, qty, fill_price, decision_price, cost, reason).
    """
    q, p = c("qty"), c("fill_price")
    real = F.coalesce("cost", F.lit(0.0)) + F.coalesce(F.abs(p - c("decision_price")) * q, F.lit(0.0))
    df = fills.filter(q.isNotNull() & p.isNotNull()).withColumns(
        {
            "_v": q * p,
            "_r": real,
            "_b": modelled_cost(c("side"), q, p, CostConfig()),
            "_p": modelled_cost(c("side"), q, p, CostConfig.pessimistic()),
        }
    )
    bps = lambda x: F.try_divide(F.sum(x), F.sum("_v")) * 10_000
    return df.rollup("decision_date").agg(
        headline(c("reason")).alias("reason"),
        F.sum("_v").alias("notional"),
        F.sum("_r").alias("realized_cost"),
        bps("_r").alias("realized_bps"),
        bps("_b").alias("base_bps"),
        bps("_p").alias("pess_bps"),
        (F.sum("_r") <= F.sum("_p")).alias("within_band"),
    )


def rebalance_events(fills: DataFrame) -> DataFrame:
    """One event per decision date, newest first; its fills stay rows (:func:`event_fills`)."""
    side = lambda s: F.sum((c("side") == s).cast("long"))
    return (
        fills.groupBy("decision_date")
        .agg(
            headline(c("reason")).alias("reason"),
            side("buy").alias("n_buys"),
            side("sell").alias("n_sells"),
            side("trim").alias("n_trims"),
            F.sum(F.coalesce("cost", F.lit(0.0))).alias("total_cost"),
        )
        .orderBy(c("decision_date").desc())
    )


def event_fills(fills: DataFrame) -> DataFrame:
    """Fills with the headline of their event.  A list per event would gather an unbounded group."""
    events = fills.groupBy("decision_date").agg(headline(c("reason")).alias("event_reason"))
    return fills.join(events, "decision_date")


def live_turnover(fills: DataFrame, nav: DataFrame, expected_pct: float = 581.0) -> DataFrame:
    """Two-way turnover on average NAV, annualised by the days observed, against expectation."""
    traded = fills.agg(F.sum(F.abs(c("qty") * c("fill_price")))).scalar()
    return (
        nav.agg(F.avg("equity").alias("_nav"), F.count("*").alias("n_days"))
        .select("n_days", (F.try_divide(traded, c("_nav")) * F.try_divide(F.lit(float(TRADING_DAYS)), c("n_days")) * 100).alias("live_annualized_pct"))
        .withColumn("ratio", c("live_annualized_pct") / expected_pct)
    )


def cost_path(events: DataFrame, expected_per_event: float) -> DataFrame:
    """Running cost and turnover multiple over decision dates (one row per date)."""
    w = one_series("decision_date").rowsBetween(Window.unboundedPreceding, 0)
    return events.select(
        "decision_date",
        F.sum("total_cost").over(w).alias("cumulative_cost"),
        (F.sum("notional").over(w) / (F.count("*").over(w) * expected_per_event)).alias("turnover_multiple"),
    )


def execution_cost(fills: DataFrame, opens: DataFrame) -> DataFrame:
    """Statutory charges and slippage against the raw open, over all fills."""
    df = fills.join(opens.select("isin", "date", c("open").alias("_open")), ["isin", "date"], "left")
    slip = F.coalesce(F.abs(c("price") - c("_open")) * c("qty"), F.lit(0.0))
    out = df.agg(
        F.sum("cost").alias("statutory"), F.sum(slip).alias("slippage"), F.sum(c("qty") * c("price")).alias("notional")
    )
    return out.withColumn("total_bps", F.try_divide(c("statutory") + c("slippage"), c("notional")) * 10_000)


def concentration(positions: DataFrame) -> DataFrame:
    """Herfindahl index, effective names and top weights of a book (one row per holding)."""
    total = positions.agg(F.sum("mv")).scalar()
    w = positions.select((c("mv") / total).alias("w"))
    top5 = w.orderBy(c("w").desc()).limit(5).agg(F.sum("w")).scalar()
    return w.agg(F.sum(c("w") * c("w")).alias("hhi"), F.max("w").alias("top1")).withColumns(
        {"effective_n": F.try_divide(F.lit(1.0), c("hhi")), "top5": top5}
    )


def book_positions(positions: DataFrame, prices: DataFrame, cash: float) -> DataFrame:
    """Market value, unrealised % and weight of NAV, largest first."""
    df = positions.join(prices.select("isin", c("close").alias("price")), "isin").withColumn("mv", c("shares") * c("price"))
    nav = df.agg(F.sum("mv")).scalar() + cash
    return df.select(
        "isin", "mv", ((F.try_divide("price", "cost_basis") - 1) * 100).alias("unrealised_pct"), F.try_divide(c("mv"), nav).alias("weight")
    ).orderBy(c("mv").desc(), "isin")


def weight_parity(engine: DataFrame, live: DataFrame, tol_bps: float) -> DataFrame:
    """Names whose weight differs between two books, in basis points, and the verdict."""
    df = engine.select("isin", c("weight").alias("_a")).join(live.select("isin", c("weight").alias("_b")), "isin", "full_outer")
    dev = F.abs(F.coalesce("_a", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0))) * 10_000
    return df.select("isin", dev.alias("dev_bps"), (dev > tol_bps).alias("breach"))


def rebalance_plan(holdings: DataFrame, ranks: DataFrame, equity: float, fraction: float, n: int = 20, m: int = 35,
                   max_pct: float = 10.0) -> DataFrame:
    """Sells, buys and trims of one decision.

    holdings (isin, shares, last_price); ranks (isin, rank, price, gate_ok).  A holding
    goes when unranked, ranked past m or gated out; survivors stay and free slots go
    to names ranked within n, all at one capped target value.
    """
    target = min(equity * fraction / n, equity * max_pct / 100)
    df = holdings.join(ranks, "isin", "full_outer")
    held = c("shares").isNotNull()
    keep = held & sure((c("rank") <= m) & c("gate_ok"))
    fresh = ~held & sure(c("rank") <= n)
    df = df.withColumns({"_keep": keep, "_fresh": fresh})
    # Survivors come first, then entrants by rank; the first n of them are the target set.
    chosen = df.filter(c("_keep") | c("_fresh")).orderBy((~c("_keep")).cast("int"), "rank").limit(n).select("isin", F.lit(True).alias("_in"))
    df = df.join(chosen, "isin", "left")
    price = F.coalesce("last_price", "price")
    gap = target - F.coalesce(c("shares") * c("last_price"), F.lit(0.0))
    side = (
        F.when(held & ~c("_keep"), "sell")
        .when(sure(c("_in")) & (price > 0) & (gap > 1e-9 * price), "buy")
        .when(sure(c("_in")) & held & (price > 0) & (gap < -1e-9 * price), "trim")
    )
    qty = F.when(side == "sell", c("shares")).otherwise(F.abs(gap) / price)
    return df.select("isin", side.alias("side"), qty.alias("qty"), price.alias("price")).filter(c("side").isNotNull())


def plan_turnover(plan: DataFrame, holdings: DataFrame, equity: float) -> DataFrame:
    """Sum of weight changes over all touched names."""
    before = holdings.select("isin", (c("shares") * c("last_price") / equity).alias("_w"))
    df = plan.join(before, "isin", "left").withColumn("_w", F.coalesce("_w", F.lit(0.0)))
    step = c("qty") * c("price") / equity
    after = F.when(c("side") == "sell", 0.0).when(c("side") == "buy", c("_w") + step).otherwise(F.greatest(F.lit(0.0), c("_w") - step))
    return df.agg(F.sum(F.abs(after - c("_w"))).alias("turnover"))


def order_candidates(candidates: DataFrame, selector: str, seed: int = 0) -> DataFrame:
    """Candidates of each day in selection order; missing measures last."""
    keys = {
        "adv": [c("adv_20").desc_nulls_last()],
        "mom": [c("mom").desc_nulls_last()],
        "rs": [c("excess").desc_nulls_last()],
        "random": [scan.seeded_order(F.lit(seed), c("isin")).asc()],
    }[selector]
    w = Window.partitionBy("date").orderBy(*keys, "isin")
    return candidates.select("date", "isin", F.row_number().over(w).alias("place"))


def most_liquid(prices: DataFrame, on: Column, floor: float, n: int) -> DataFrame:
    return prices.filter((c("date") == on) & (c("adv_20") >= floor)).orderBy(c("adv_20").desc(), "isin").limit(n).select("isin", "adv_20")


def newest(events: DataFrame, time: str, tie: str, kind: str | None = None, kind_column: str = "alert_type", n: int | None = None) -> DataFrame:
    df = events if kind is None else events.filter(c(kind_column) == kind)
    df = df.orderBy(c(time).desc(), c(tie).desc())
    return df if n is None else df.limit(n)


def clean_clock(checks: DataFrame) -> DataFrame:
    """Passes since the last failure, and the date of that failure."""
    reset = checks.agg(F.max(F.when(~c("passed"), c("date")))).scalar()
    since = reset.isNull() | (c("date") > reset)
    return checks.agg(F.sum((c("passed") & since).cast("long")).alias("clean"), F.max(reset).alias("reset_date"))


def missing_days(calendar: DataFrame, processed: DataFrame, start: Column, end: Column) -> DataFrame:
    return calendar.filter(c("date").between(start, end)).join(processed.select("date"), "date", "left_anti")


# Least days and greatest shortfall in points of the directional gate.
DIRECTIONAL_DAYS, DIRECTIONAL_LIMIT = 20, 15.0


def directional(nav: DataFrame, least_days: int = DIRECTIONAL_DAYS, limit: float = DIRECTIONAL_LIMIT) -> DataFrame:
    """Status of the soft gate: the book's growth not more than ``limit`` points below the index, one row."""
    both = nav.filter(c("benchmark").isNotNull())
    grown = lambda x: F.when(F.min_by(x, "date") > 0, F.try_divide(F.max_by(x, "date"), F.min_by(x, "date")) * 100 - 100).otherwise(0.0)
    gap = grown("equity") - grown("benchmark")
    status = F.when(F.count("*") < least_days, "insufficient_data").when(gap < -limit, "fail").otherwise("pass")
    return both.agg(status.alias("directional"))


def scorecard(clock: DataFrame, missing: DataFrame, ledger_total: DataFrame, stops: DataFrame, drawdown: DataFrame,
              nav: DataFrame, max_stops: int = 5, max_dd_pct: float = 23.1, months_needed: int = 6) -> DataFrame:
    """Gates and kill rules folded into one verdict row.

    Fidelity, operation and cost are hard gates, direction a soft one that only reports.  Fidelity is
    failed for good by one failed check and so bars graduation; it puts the book at risk only while the
    newest check is the failed one.  A gate without data passes nothing and fails nothing.
    """
    gaps = missing.agg(F.count("*")).scalar()
    band = ledger_total.agg(F.max("within_band")).scalar()
    worst = stops.agg(F.coalesce(F.max("stops"), F.lit(0))).scalar()
    dd = drawdown.select("max_drawdown").scalar()

    def status(passed: Column) -> Column:
        return F.when(passed.isNull(), "insufficient_data").when(passed, "pass").otherwise("fail")

    df = clock.withColumns(
        {
            "fidelity": status(F.when(c("clean").isNotNull(), c("reset_date").isNull())),
            "operational": status(gaps == 0),
            "cost": status(band),
            "directional": directional(nav).scalar(),
            "killed": F.coalesce(worst >= max_stops, F.lit(False)) | F.coalesce(dd * 100 > max_dd_pct, F.lit(False)),
        }
    )
    failing_now = c("reset_date").isNotNull() & (c("clean") == 0)
    hard_pass = (c("fidelity") == "pass") & (c("operational") == "pass") & (c("cost") == "pass")
    verdict = (
        F.when(c("killed"), "HALT")
        .when(failing_now | (c("operational") == "fail") | (c("cost") == "fail"), "AT RISK")
        .when((c("clean") >= months_needed) & hard_pass, "GRADUATED")
        .when(c("reset_date").isNotNull(), "CLOCK RESET")
        .otherwise("ON TRACK")
    )
    return df.withColumn("verdict", verdict)
