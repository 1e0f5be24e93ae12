"""Trades, fills, round trips and positions.

Fills and trades are raw-feed sized and may be dominated by one instrument; every
ordered step goes through per-day tables (see ``barloom.functions.scan``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import scan
from barloom.functions.asof import asof_join
from barloom.functions.windows import bars_window, one_series, running, sure

c = F.col
FAR_FUTURE = "9999-12-31"
ROUND_TRIP_COST_PCT = 0.3


def excess_over_index(prices: DataFrame, index: DataFrame, lookback: int = 126) -> DataFrame:
    """Trailing return of each name less the index's on the same date."""
    mom = c("close") / F.lag("close", lookback).over(bars_window("isin")) - 1
    base = index.select("date", (c("level") / F.lag("level", lookback).over(one_series()) - 1).alias("_b"))
    df = prices.select("isin", "date", mom.alias("_m")).filter(c("_m").isNotNull())
    return df.join(base, "date").select("isin", "date", (c("_m") - c("_b")).alias("excess"))


# --- trade statistics ---------------------------------------------------------


def trade_metrics(trades: DataFrame, capital: float = 1e6, cost_pct: float = ROUND_TRIP_COST_PCT) -> DataFrame:
    """Net win rate, averages, expectancy, size-weighted profit factor and cost drag, one row."""
    r, p = c("return_pct") - cost_pct, c("size")
    win = r > 0
    df = trades.withColumns({"_r": r, "_w": win})
    r, win = c("_r"), c("_w")

    def part(x: Column, cond: Column) -> Column:
        return F.sum(F.when(cond, x))

    out = df.agg(
        F.count("*").alias("total_trades"),
        F.sum(win.cast("long")).alias("winning_trades"),
        F.avg(r).alias("avg_return_pct"),
        F.max(r).alias("best_trade_pct"),
        F.min(r).alias("worst_trade_pct"),
        (F.sum(r / 100 * p) / capital * 100).alias("total_return_pct"),
        (F.sum(c("return_pct") / 100 * p) / capital * 100).alias("gross_return_pct"),
        F.coalesce(F.avg(F.when(win, r)), F.lit(0.0)).alias("avg_win_pct"),
        F.coalesce(F.avg(F.when(~win, r)), F.lit(0.0)).alias("avg_loss_pct"),
        part(r * p, win).alias("_gain"),
        part(r * p, ~win).alias("_lost"),
    )
    rate = F.coalesce(F.try_divide("winning_trades", "total_trades"), F.lit(0.0))
    factor = (
        F.when(F.coalesce("_lost", F.lit(0.0)) != 0, F.round(F.coalesce("_gain", F.lit(0.0)) / F.abs("_lost"), 4))
        .when(c("_gain").isNotNull(), 99.0)
        .otherwise(0.0)
    )
    out = out.withColumns({x: F.coalesce(c(x), F.lit(0).cast(t)) for x, t in out.dtypes if not x.startswith("_")})  # an empty run has zeros
    return out.withColumns(
        {
            "win_rate": rate * 100,
            "total_cost_drag_pct": c("gross_return_pct") - c("total_return_pct"),
            "expectancy": rate * c("avg_win_pct") + (1 - rate) * c("avg_loss_pct"),
            "profit_factor": factor,
            "median_return_pct": F.coalesce(scan.quantiles(df, "_r", {"m": 0.5}).scalar(), F.lit(0.0)),
        }
    ).drop("_gain", "_lost")


def adverse_excursion(trades: DataFrame, bars: DataFrame, block: int = 32) -> DataFrame:
    """``trades`` with ``mae_pct``: the deepest low from entry to exit day, in percent of the entry price, 0 at most.

    Trades (trade_id, symbol, entry_date, exit_date, entry_price) meet the lows of blocks of days: whole
    blocks inside a hold through one row a block, the days at its two ends through the bars themselves.
    """
    number = lambda d: F.datediff(d, F.lit("1970-01-01"))
    days = bars.select("symbol", number(c("date")).alias("_d"), "low").withColumn("_b", F.floor(c("_d") / block))
    blocks = days.groupBy("symbol", "_b").agg(F.min("low").alias("low"))
    span = trades.select("trade_id", "symbol", number(c("entry_date")).alias("_from"), number(c("exit_date")).alias("_to"))
    span = span.withColumns({"_bf": F.floor(c("_from") / block), "_bt": F.floor(c("_to") / block)})
    inner = span.filter(c("_bt") - c("_bf") >= 2).withColumn("_b", F.explode(F.sequence(c("_bf") + 1, c("_bt") - 1)))
    whole = inner.join(blocks, ["symbol", "_b"]).select("trade_id", "low")
    ends = span.withColumn("_b", F.explode(F.array_distinct(F.array("_bf", "_bt"))))
    edge = ends.join(days, ["symbol", "_b"]).filter(c("_d").between(c("_from"), c("_to"))).select("trade_id", "low")
    worst = whole.unionByName(edge).groupBy("trade_id").agg(F.min("low").alias("_low"))
    fall = F.try_divide(c("_low"), c("entry_price")) * 100 - 100
    return trades.join(worst, "trade_id", "left").withColumn("mae_pct", F.least(F.coalesce(fall, F.lit(0.0)), F.lit(0.0))).drop("_low")


def exit_breakdown(trades: DataFrame) -> DataFrame:
    """Map of exit reason to trade count, one row."""
    n = trades.groupBy("exit_reason").agg(F.count("*").alias("n"))
    return n.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("exit_reason", "n")))).alias("exit_breakdown"))


def grouped_stats(trades: DataFrame) -> DataFrame:
    """Return statistics by exit reason, regime and sector in one grouping-sets pass.

    Medians come from value counts, so no group's returns meet in one task.
    """
    dims = ("exit_reason", "regime", "sector")
    sets = [[c(d)] for d in dims]
    stats = trades.groupingSets(sets, *[c(d) for d in dims]).agg(
        F.count("*").alias("n"), F.avg("return_pct").alias("mean"), F.stddev_samp("return_pct").alias("std")
    )
    tall = trades.select("return_pct", F.inline(F.array(*[F.struct(F.lit(d).alias("_d"), c(d).alias("_k")) for d in dims])))
    medians = scan.quantiles(tall, "return_pct", {"median": 0.5}, ["_d", "_k"])
    which = F.when(c("exit_reason").isNotNull(), "exit_reason").when(c("regime").isNotNull(), "regime").otherwise("sector")
    keyed = stats.withColumns({"_d": which, "_k": F.coalesce(*dims)})
    return keyed.join(medians, ["_d", "_k"]).select(*dims, "n", "mean", "median", "std")


def year_month_returns(trades: DataFrame) -> DataFrame:
    """Summed returns by exit year and month, zero where nothing closed."""
    months = list(range(1, 13))
    df = trades.groupBy(F.year("exit_date").alias("year"), F.month("exit_date").alias("m")).agg(F.sum("return_pct").alias("r"))
    out = df.groupBy("year").pivot("m", months).agg(F.sum("r")).fillna(0.0)
    return out.select("year", *[c(str(i)).alias(f"m{i:02d}") for i in months])


def regime_exit_matrix(trades: DataFrame, reasons: Sequence[str]) -> DataFrame:
    """Trade counts by regime and exit reason, zero where none."""
    n = trades.groupBy("regime", "exit_reason").agg(F.count("*").alias("n"))
    return n.groupBy("regime").pivot("exit_reason", list(reasons)).agg(F.sum("n")).fillna(0)


def best_and_worst(trades: DataFrame, n: int = 10) -> DataFrame:
    keys = ["trade_id", "size", "entry_date"]
    best = trades.orderBy(c("return_pct").desc(), *keys).limit(n).withColumn("side", F.lit("best"))
    worst = trades.orderBy(c("return_pct").asc(), *keys).limit(n).withColumn("side", F.lit("worst"))
    return best.unionByName(worst).select("side", "trade_id", "symbol", "return_pct", "size")


SORTABLE = ("return_pct", "entry_date", "exit_date", "holding_days", "size")


def trade_page(trades: DataFrame, sort_by: str = "entry_date", descending: bool = True, exit_reason: str | None = None,
               page: int = 1, page_size: int = 50) -> DataFrame:
    """One ordered page; the sort column must be on the list."""
    if sort_by not in SORTABLE:
        raise ValueError(f"cannot sort by {sort_by!r}")
    df = trades if exit_reason is None else trades.filter(c("exit_reason") == exit_reason)
    key = c(sort_by).desc() if descending else c(sort_by).asc()
    return df.orderBy(key, "trade_id", "size", "entry_date").offset((page - 1) * page_size).limit(page_size)


def gini(values: DataFrame, column: str) -> DataFrame:
    """Mean-absolute-difference Gini from ranks; equal values are grouped before any ordering."""
    grouped = values.groupBy(c(column).alias("v")).agg(F.count("*").alias("n"))
    total = grouped.agg(F.sum("n")).scalar()
    ranked = scan.prefix_sums(grouped, "v", ["n"])
    spread = F.sum(c("v") * c("n") * (2 * c("before_n") + c("n") - total))
    mean = F.sum(c("v") * c("n")) / F.max(total)
    return ranked.agg(F.when(mean != 0, spread / (F.pow(F.max(total), 2) * mean)).alias("gini"))


def top_k_share(values: DataFrame, column: str, k: int) -> DataFrame:
    top = values.orderBy(c(column).desc()).limit(k).agg(F.sum(column)).scalar()
    return values.agg(F.sum(column).alias("_t")).select(F.when(c("_t") != 0, top / c("_t")).alias("share"))


def mapped_exits(trades: DataFrame, index: DataFrame) -> DataFrame:
    """Exit date to the next index date, the last one when none follows."""
    last = index.agg(F.max("date")).scalar()
    days = trades.select("exit_date").distinct()
    got = asof_join(days, index.select("date", c("date").alias("mapped")), [], "exit_date", "date", ["mapped"],
                    forward=True, unique_left=True)
    return got.select("exit_date", F.coalesce("mapped", last).alias("mapped"))


def equity_curve(trades: DataFrame, index: DataFrame, capital: float = 1e6, cost_pct: float = ROUND_TRIP_COST_PCT) -> DataFrame:
    """Realised equity per index date with the rebased index and drawdown state."""
    per_exit = trades.groupBy("exit_date").agg(F.sum((c("return_pct") - cost_pct) / 100 * c("size")).alias("pnl"))
    daily = per_exit.join(mapped_exits(per_exit, index), "exit_date").groupBy(c("mapped").alias("date")).agg(F.sum("pnl").alias("pnl"))
    run = one_series().rowsBetween(Window.unboundedPreceding, 0)
    df = index.select("date", "level").join(daily, "date", "left")
    df = df.withColumn("equity", capital + F.sum(F.coalesce("pnl", F.lit(0.0))).over(run))
    first = F.first("level").over(one_series().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    df = df.withColumns(
        {
            "benchmark_equity": c("level") / first * capital,
            "_peak": F.greatest(F.max("equity").over(run), F.lit(capital)),
        }
    )
    prior = F.coalesce(F.lag("_peak").over(one_series()), F.lit(capital))
    df = df.withColumns(
        {"drawdown_pct": (c("_peak") - c("equity")) / c("_peak") * 100, "_high": (c("equity") > prior).cast("int")}
    ).withColumn("_run", F.sum("_high").over(run))
    spell = Window.partitionBy("_run").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("dd_days", F.sum(1 - c("_high")).over(spell))
    return df.select("date", "equity", "benchmark_equity", "drawdown_pct", "dd_days")


def curve_summary(curve: DataFrame, capital: float = 1e6) -> DataFrame:
    prev = F.coalesce(F.lag("equity").over(one_series()), F.lit(capital))
    df = curve.withColumn("_r", F.when(prev > 0, c("equity") / prev - 1))
    sd = F.stddev_pop("_r")
    return df.agg(
        F.max("drawdown_pct").alias("max_drawdown_pct"),
        F.max("dd_days").alias("max_drawdown_duration"),
        F.when(sd > 0, F.avg("_r") / sd * F.sqrt(F.lit(252.0))).otherwise(0.0).alias("sharpe_ratio"),
        ((F.max_by("benchmark_equity", "date") / F.min_by("benchmark_equity", "date") - 1) * 100).alias("benchmark_return_pct"),
    )


# --- concurrency --------------------------------------------------------------


def daily_concurrency(trades: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Open trades and capital per calendar day (both ends included), per extra key.

    Two signed events per trade, combined per day before any window: a trade costs two
    rows however long it is held.
    """
    keys = list(by)
    opens = trades.select(*keys, c("entry_date").alias("date"), F.lit(1).alias("n"), c("size").alias("cap"))
    closes = trades.select(*keys, F.date_add("exit_date", 1).alias("date"), F.lit(-1).alias("n"), (-c("size")).alias("cap"))
    steps = opens.unionByName(closes).groupBy(*keys, "date").agg(F.sum("n").alias("n"), F.sum("cap").alias("cap"))
    span = steps.groupBy(*keys).agg(F.min("date").alias("a"), F.max("date").alias("b")).select(
        *keys, F.explode(F.sequence("a", F.date_sub("b", 1))).alias("date")
    )
    df = span.join(steps, [*keys, "date"], "left")
    w = running(keys or [F.lit(0)])
    return df.select(
        *keys,
        "date",
        F.sum(F.coalesce("n", F.lit(0))).over(w).alias("active"),
        F.sum(F.coalesce("cap", F.lit(0.0))).over(w).alias("capital"),
    )


def concurrency_footprint(trades: DataFrame) -> DataFrame:
    names = trades.agg(F.countDistinct("symbol")).scalar()
    p = F.percentile("active", F.array(F.lit(0.95), F.lit(0.99)))
    return daily_concurrency(trades).agg(F.max("active").alias("max_active"), p.alias("_p")).select(
        "max_active", c("_p")[0].alias("p95"), c("_p")[1].alias("p99"), names.alias("names")
    )


def cap_breaches(trades: DataFrame, capital: float, max_positions: int, max_per_sector: int) -> DataFrame:
    """Days on which overlapping trades exceed the capital, position or sector limits."""
    total = daily_concurrency(trades).select(
        "date",
        F.lit("ALL").alias("scope"),
        "active",
        (c("capital") > capital).alias("over_capital"),
        (c("active") > max_positions).alias("over_count"),
    )
    sector = daily_concurrency(trades, ["sector"]).select(
        "date", c("sector").alias("scope"), "active", F.lit(False).alias("over_capital"), (c("active") > max_per_sector).alias("over_count")
    )
    return total.unionByName(sector).filter(c("over_capital") | c("over_count"))


# --- fills --------------------------------------------------------------------


def per_name_stats(fills: DataFrame) -> DataFrame:
    """Realised P&L, counts, holding days and closed flag per name."""
    buy = c("side") == "buy"
    notional = c("qty") * c("price")
    df = fills.groupBy("isin").agg(
        F.coalesce(F.sum(F.when(buy, notional)), F.lit(0.0)).alias("buy_notional"),
        F.coalesce(F.sum(F.when(~buy, notional)), F.lit(0.0)).alias("sell_notional"),
        F.sum("cost").alias("cost_paid"),
        F.sum(buy.cast("long")).alias("n_buys"),
        F.sum((~buy).cast("long")).alias("n_sells"),
        F.datediff(F.max(F.when(~buy, c("date"))), F.min(F.when(buy, c("date")))).alias("hold_days"),
    )
    return df.withColumns(
        {
            "realized_pnl": c("sell_notional") - c("buy_notional") - c("cost_paid"),
            "is_closed": c("n_sells") > 0,
        }
    )


def hit_rate(stats: DataFrame) -> DataFrame:
    return stats.filter("is_closed").agg(F.avg((c("realized_pnl") > 0).cast("double")).alias("hit_rate"))


def yearly_contributors(fills: DataFrame, top: int = 10) -> DataFrame:
    """Largest net cash flows per year."""
    flow = F.when(c("side") == "buy", -c("qty") * c("price")).otherwise(c("qty") * c("price")) - c("cost")
    df = fills.groupBy(F.year("date").alias("year"), "isin").agg(F.sum(flow).alias("flow"))
    order = Window.partitionBy("year").orderBy(c("flow").desc(), "isin")
    return df.withColumn("place", F.row_number().over(order)).filter(c("place") <= top)


def contributor_rotation(contributors: DataFrame, min_distinct: int) -> DataFrame:
    return contributors.agg(F.countDistinct("isin").alias("names")).withColumn("passed", c("names") >= min_distinct)


def hold_windows(fills: DataFrame) -> DataFrame:
    """First buy to last sell of each name; open-ended when it never sold."""
    buy = c("side") == "buy"
    return fills.groupBy("isin").agg(
        F.min(F.when(buy, c("date"))).alias("start"),
        F.coalesce(F.max(F.when(~buy, c("date"))), F.lit(FAR_FUTURE).cast("date")).alias("end"),
    ).filter(c("start").isNotNull())


def round_trips(fills: DataFrame, exits: DataFrame | None = None) -> DataFrame:
    """Buy followed by its closing fill; a buy overtaken by another buy starts no trip.

    The last buy of a name stays open.  The k-th closed trip of a name takes the k-th
    exit reason.
    """
    order = ["fill_id", "side", "qty", "price"]
    nxt = scan.next_row(fills, ["isin"], "date", order, ["cost"], "_n")
    trips = nxt.filter((c("side") == "buy") & (c("_n").isNull() | (c("_n.side") != "buy"))).select(
        "isin",
        c("date").alias("entry_date"),
        c("fill_id").alias("buy_id"),
        c("qty").alias("buy_qty"),
        c("price").alias("buy_price"),
        c("_n.date").alias("exit_date"),
        (c("qty") * c("price")).alias("buy_notional"),
        F.coalesce(c("_n.qty") * c("_n.price"), F.lit(0.0)).alias("sell_notional"),
        (c("cost") + F.coalesce(c("_n.cost"), F.lit(0.0))).alias("cost"),
    )
    trips = trips.withColumn("hold_days", F.datediff("exit_date", "entry_date"))
    if exits is None:
        return trips
    closed = scan.number_rows(trips.filter(c("exit_date").isNotNull()), ["isin"], "entry_date",
                              ["buy_id", "buy_qty", "buy_price"], "k")
    reasons = scan.number_rows(exits, ["isin"], "date", ["fill_id", "reason"], "k").select("isin", "k", c("reason").alias("exit_reason"))
    done = closed.join(reasons, ["isin", "k"], "left").withColumn("exit_reason", F.coalesce("exit_reason", F.lit("unknown")))
    still = trips.filter(c("exit_date").isNull()).withColumns({"k": F.lit(None).cast("long"), "exit_reason": F.lit("still_open")})
    return done.unionByName(still)


def trip_forensic(trips: DataFrame) -> DataFrame:
    """Win rate, payoff, expectancy and holding percentiles per exit reason and in total."""
    pnl = c("sell_notional") - c("buy_notional") - c("cost")
    df = trips.filter(c("exit_date").isNotNull()).withColumn("pnl", pnl)
    win = c("pnl") > 0
    q = F.percentile("hold_days", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.rollup("exit_reason").agg(
        F.count("*").alias("n"),
        (F.avg(win.cast("double")) * 100).alias("win_rate"),
        F.avg("pnl").alias("expectancy"),
        F.try_divide(F.avg(F.when(win, c("pnl"))), F.abs(F.avg(F.when(~win, c("pnl"))))).alias("payoff"),
        q.alias("_q"),
    )
    return out.select(
        F.coalesce("exit_reason", F.lit("ALL")).alias("exit_reason"), "n", "win_rate", "expectancy", "payoff",
        c("_q")[0].alias("hold_p25"), c("_q")[1].alias("hold_p50"), c("_q")[2].alias("hold_p75"),
    )


def end_of_day_holdings(fills: DataFrame, rows: int = scan.RANGE_ROWS) -> DataFrame:
    """Quantity held per (isin, day with fills), at its start and end.

    Buys add, trims subtract down to zero, a sell clears.  A range of a day's fills maps the
    holding h to max(a, h + b), or to a constant once it contains a sell; such maps compose, so
    the ranges of a name are chained by running sums and a running maximum.
    """
    order = ["fill_id", "side", "qty", "price"]
    unit = ["isin", "date", "_r"]
    w = Window.partitionBy(*unit).orderBy(*order)
    df = scan.day_ranges(fills, ["isin"], "date", "fill_id", rows)
    df = df.withColumn("_cut", F.sum((c("side") == "sell").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    step = F.when(c("side") == "buy", c("qty")).when(c("side") == "trim", -c("qty")).otherwise(0.0)
    part = Window.partitionBy(*unit, "_cut").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_s", F.sum(step).over(part))
    per_part = df.groupBy(*unit, "_cut").agg(F.sum(step).alias("_b"), F.min("_s").alias("_m"))
    last = per_part.groupBy(*unit).agg(F.max(F.struct("_cut", "_b", "_m")).alias("_l"))
    parts = last.select(*unit, (c("_l._cut") > 0).alias("_sold"), c("_l._b").alias("_b"), (c("_l._b") - F.least(c("_l._m"), F.lit(0.0))).alias("_a"))
    by_name = Window.partitionBy("isin").orderBy("date", "_r")
    parts = parts.withColumn("_isle", F.sum(c("_sold").cast("int")).over(by_name.rowsBetween(Window.unboundedPreceding, 0)))
    isle = Window.partitionBy("isin", "_isle").orderBy("date", "_r").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("_p", F.sum(F.when(c("_sold"), 0.0).otherwise(c("_b"))).over(isle))
    best = F.max(c("_a") - c("_p")).over(isle)
    before_any = F.when(c("_isle") == 0, F.greatest(best, F.lit(0.0))).otherwise(best)
    parts = parts.withColumn("_end", before_any + c("_p")).withColumn("_start", F.coalesce(F.lag("_end").over(by_name), F.lit(0.0)))
    return parts.groupBy("isin", "date").agg(F.min_by("_start", "_r").alias("held_start"), F.max_by("_end", "_r").alias("held_end"))


def turnover_split(fills: DataFrame, nav: DataFrame, eps: float = 1e-9) -> DataFrame:
    """Two-way turnover by entry, exit and reweight, in weights of the day's equity."""
    df = fills.join(nav.filter(c("equity") > 0).select("date", "equity"), "date")
    held = end_of_day_holdings(df)
    dw = c("qty") * c("price") / c("equity")
    days = df.groupBy("isin", "date").agg(
        *[F.coalesce(F.sum(F.when(c("side") == s, dw)), F.lit(0.0)).alias(s) for s in ("buy", "sell", "trim")]
    )
    known = days.join(held, ["isin", "date"]).withColumn("_held", c("held_start") > eps)
    out = known.agg(
        F.sum(F.when(~c("_held"), c("buy")).otherwise(0.0)).alias("entry"),
        F.sum("sell").alias("exit"),
        F.sum(c("trim") + F.when(c("_held"), c("buy")).otherwise(0.0)).alias("reweight"),
    )
    return out.withColumn("total", c("entry") + c("exit") + c("reweight"))


def churn(split: DataFrame, turnover: float) -> DataFrame:
    return split.select((F.try_divide(c("entry") + c("exit"), c("total")) * turnover).alias("churn"))


def holdings_timeline(fills: DataFrame, rebalance: DataFrame) -> DataFrame:
    """Names held at each rebalance date: the last buy or sell before it was a buy.

    Each day's last side opens or closes a span; the rebalance dates inside a span come
    from one small calendar array.
    """
    moves = fills.filter(c("side") != "trim").groupBy("isin", "date").agg(
        F.max_by("side", F.struct("fill_id", "side", "qty", "price")).alias("side")
    )
    until = F.lead("date").over(bars_window("isin"))
    calendar = rebalance.agg(F.array_sort(F.collect_set("date"))).scalar()
    spans = moves.withColumns({"_until": until, "_days": calendar}).filter(c("side") == "buy")
    hit = F.filter("_days", lambda d: (d >= c("date")) & (c("_until").isNull() | (d < c("_until"))))
    return spans.select("isin", F.explode(hit).alias("date"))


def held_set_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean Jaccard distance of two held sets per date."""
    left = a.select("date", "isin", F.lit(1).alias("_a"))
    right = b.select("date", "isin", F.lit(1).alias("_b"))
    both = left.join(right, ["date", "isin"], "full_outer")
    apart = (c("_a").isNull() | c("_b").isNull()).cast("double")
    per_date = both.groupBy("date").agg(F.avg(apart).alias("distance"))
    return per_date.agg(F.avg("distance").alias("mean_distance"), F.count("*").alias("dates"))


def matched_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Share of one run's trades that the other run entered too."""
    keys = ["isin", "entry_date"]
    left, right = a.select(*keys).distinct(), b.select(*keys).distinct()
    n = left.join(right, keys).agg(F.count("*")).scalar()
    return left.agg(F.count("*").alias("trades")).withColumn("matched", n).withColumn("fraction", F.try_divide("matched", "trades"))


def held_gaps(windows: DataFrame, bars: DataFrame) -> DataFrame:
    """Market days inside a hold window on which the name has no bar.

    Consecutive bars (and the window's ends) are neighbours in one window; only the
    missing days between them are generated.
    """
    days = bars.select("date").distinct().withColumn("ord", F.row_number().over(one_series()))
    edge = days.agg(F.max("ord")).scalar()
    first = asof_join(windows.select("isin", "start", "end"), days.select("date", c("ord").alias("a")), [], "start", "date", ["a"], forward=True)
    both = asof_join(first, days.select("date", c("ord").alias("b")), [], "end", "date", ["b"])
    spans = both.select("isin", "a", F.coalesce("b", edge).alias("b"))
    marks = (
        bars.select("isin", "date").join(days, "date").join(spans, "isin").filter(c("ord").between(c("a"), c("b"))).select("isin", "ord")
        .unionByName(spans.select("isin", (c("a") - 1).alias("ord")))
        .unionByName(spans.select("isin", (c("b") + 1).alias("ord")))
    )
    prev = F.lag("ord").over(Window.partitionBy("isin").orderBy("ord"))
    gaps = marks.withColumn("_p", prev).filter(c("ord") - c("_p") > 1)
    missing = gaps.select("isin", F.explode(F.sequence(c("_p") + 1, c("ord") - 1)).alias("ord"))
    return missing.join(days, "ord").select("isin", "date")


# --- positions ------------------------------------------------------------------


def open_trades(positions: DataFrame, prices: DataFrame) -> DataFrame:
    """Unrealised P&L and distances of open positions; no price means the entry price."""
    df = positions.filter(c("status") == "open").join(prices.select("symbol", c("close").alias("_p")), "symbol", "left")
    price, entry = F.coalesce("_p", "entry_price"), c("entry_price")
    return df.select(
        "symbol",
        "trade_id",
        price.alias("current_price"),
        ((price - entry) * c("qty")).alias("unrealised"),
        ((price - entry) / entry * 100).alias("unrealised_pct"),
        ((price - c("stop_loss")) / price * 100).alias("to_stop_pct"),
        ((c("target") - price) / price * 100).alias("to_target_pct"),
    )


def closed_trades(positions: DataFrame) -> DataFrame:
    """Realised P&L, return and holding days of closed positions."""
    entry = c("entry_price")
    return positions.filter(c("status") == "closed").select(
        "symbol",
        "trade_id",
        ((c("exit_price") - entry) * c("qty")).alias("pnl"),
        F.when(entry != 0, (c("exit_price") - entry) / entry * 100).otherwise(0.0).alias("return_pct"),
        F.datediff("exit_date", "entry_date").alias("holding_days"),
    )


def journal_stats(positions: DataFrame, prices: DataFrame) -> DataFrame:
    closed = closed_trades(positions).agg(
        F.count("*").alias("closed"),
        (F.avg((c("pnl") > 0).cast("double")) * 100).alias("win_rate"),
        F.sum("pnl").alias("total_pnl"),
        F.avg("return_pct").alias("avg_return_pct"),
    )
    live = open_trades(positions, prices).agg(F.count("*").alias("n"), F.sum("unrealised").alias("u"))
    return closed.withColumns({"open": live.select("n").scalar(), "open_unrealised": live.select("u").scalar()})


def book_summary(positions: DataFrame, prices: DataFrame) -> DataFrame:
    gain = F.sum(F.when(c("pnl") > 0, c("pnl")))
    loss = F.sum(F.when(c("pnl") < 0, -c("pnl")))
    closed = closed_trades(positions).agg(
        F.sum("pnl").alias("realised"),
        F.when(loss > 0, gain / loss).alias("profit_factor"),
        F.avg("holding_days").alias("avg_holding_days"),
    )
    live = open_trades(positions, prices).agg(F.sum("unrealised")).scalar()
    return closed.withColumn("unrealised", live)


def position_size(price: Column, atr: Column | None, capital: float = 1e6, risk_pct: float = 3.0, atr_mult: float = 2.0,
                  max_pct: float = 20.0, fixed: float = 10_000.0) -> Column:
    """Rupee size so that the stop distance risks a share of capital, capped."""
    cap = F.lit(capital * max_pct / 100)
    if atr is None:
        return F.least(F.lit(fixed), cap)
    risk = atr_mult * atr / price
    return F.when(sure(risk > 0), F.least(F.lit(capital * risk_pct / 100) / risk, cap)).otherwise(F.least(F.lit(fixed), cap))


def rescale_position(old: Column, new: Column) -> tuple[Column, Column]:
    """Cost basis and shares moved to a new factor anchor; non-positive factors raise."""
    bad = (old <= 0) | (new <= 0)
    ratio = F.when(bad, F.raise_error(F.lit("factor must be positive")).cast("double")).otherwise(new / old)
    return c("cost_basis") * ratio, c("shares") / ratio


def stop_breached(close: Column, cost_basis: Column, stop_pct: float) -> Column:
    return sure(close <= cost_basis * (1 - stop_pct / 100))


def large_moves(prices: DataFrame, windows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Big total-return moves, whether a factor step explains them and whether they were held."""
    w = bars_window("isin")
    step = F.abs(c("adj_factor") / F.lag("adj_factor").over(w) - 1) > 1e-6
    df = prices.select("isin", "date", (c("close_tr") / F.lag("close_tr").over(w) - 1).alias("move"), sure(step).alias("explained"))
    df = df.filter(F.abs(c("move")) > threshold).join(windows, "isin", "left")
    return df.select("isin", "date", "move", "explained", sure(c("date").between(c("start"), c("end"))).alias("held"))


def identity_breaks(snapshots: DataFrame, rtol: float = 1e-6) -> DataFrame:
    """Days whose equity is not cash plus invested value."""
    diff = F.abs(c("equity") - (c("cash") + c("invested")))
    return snapshots.filter(diff > rtol * F.abs(c("equity"))).select("date", diff.alias("difference"))


def spaced_dates(hits: DataFrame, gap_days: int = 60) -> DataFrame:
    """Screen dates of each symbol at least ``gap_days`` after the last kept one.

    Which dates stay depends on those kept before, so a symbol's dates (at most one
    per day) are walked in order.
    """
    import pandas as pd

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        days = pd.to_datetime(pdf["date"]).sort_values()
        kept, last = [], None
        for d in days:
            if last is None or (d - last).days >= gap_days:
                kept.append(d.date())
                last = d
        return pd.DataFrame({"symbol": pdf["symbol"].iloc[0], "date": kept})

    return hits.select("symbol", "date").distinct().groupBy("symbol").applyInPandas(walk, "symbol long, date date")
