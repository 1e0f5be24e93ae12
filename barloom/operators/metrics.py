"""NAV, benchmark-relative and validation statistics."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import scan
from barloom.functions.windows import TRADING_DAYS, one_series

c = F.col
YEAR_DAYS = 365.25
EULER = 0.5772156649015329


def daily_returns(nav: DataFrame, column: str = "equity", by: Sequence[str] = ()) -> DataFrame:
    w = Window.partitionBy(*(list(by) or [F.lit(0)])).orderBy("date")
    return nav.withColumn("ret", c(column) / F.lag(column).over(w) - 1)


def underwater(nav: DataFrame, column: str = "equity", by: Sequence[str] = ()) -> DataFrame:
    """Running peak and relative drawdown; nulls of the series stay null."""
    w = Window.partitionBy(*(list(by) or [F.lit(0)])).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return nav.withColumn("drawdown", c(column) / F.max(column).over(w) - 1)


def max_drawdown(nav: DataFrame, column: str = "equity", by: Sequence[str] = ()) -> DataFrame:
    """Depth of the worst drawdown and days from its peak to its trough."""
    w = Window.partitionBy(*(list(by) or [F.lit(0)])).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    df = underwater(nav.filter(c(column).isNotNull()), column, by).withColumn("_peak_day", F.max_by("date", F.struct(c(column), -F.datediff("date", F.lit("1970-01-01")))).over(w))
    worst = F.min(F.struct("drawdown", "date", "_peak_day"))
    out = df.groupBy(*by).agg(worst.alias("_w")) if by else df.agg(worst.alias("_w"))
    return out.select(*by, (-c("_w.drawdown")).alias("max_drawdown"), F.datediff(c("_w.date"), c("_w._peak_day")).alias("dd_days"))


def _cagr(first: Column, last: Column, days: Column) -> Column:
    return F.when((days > 0) & (first > 0), F.pow(last / first, YEAR_DAYS / days) - 1).otherwise(0.0)


def nav_metrics(nav: DataFrame, column: str = "equity", by: Sequence[str] = ()) -> DataFrame:
    """CAGR, Sharpe, Sortino, volatility, drawdown and Calmar; sample deviations."""
    df = daily_returns(nav.filter(c(column).isNotNull()), column, by)
    root = F.sqrt(F.lit(float(TRADING_DAYS)))
    sd, down = F.stddev_samp("ret"), F.stddev_samp(F.when(c("ret") < 0, c("ret")))
    aggs = [
        F.count("*").alias("days"),
        F.min("date").alias("start_date"),
        F.max("date").alias("end_date"),
        _cagr(F.min_by(column, "date"), F.max_by(column, "date"), F.datediff(F.max("date"), F.min("date"))).alias("cagr"),
        (sd * root).alias("annualized_vol"),
        F.when(sd > 0, F.avg("ret") / sd * root).otherwise(0.0).alias("sharpe"),
        F.when(down > 0, F.avg("ret") / down * root).otherwise(0.0).alias("sortino"),
    ]
    worst = max_drawdown(nav, column, by)
    if by:
        out = df.groupBy(*by).agg(*aggs).join(worst, list(by))
    else:
        out = df.agg(*aggs).withColumns({k: worst.select(k).scalar() for k in ("max_drawdown", "dd_days")})
    return out.withColumn("calmar", F.when(c("max_drawdown") > 0, c("cagr") / c("max_drawdown")))


def exposure_stats(snapshots: DataFrame, exposure: str = "exposure") -> DataFrame:
    """Mean and exact median of the invested share over all days, and the share of days not fully invested."""
    days = snapshots.filter(c(exposure).isNotNull())
    return days.agg(
        F.avg(exposure).alias("avg_exposure"),
        F.median(exposure).alias("median_exposure"),
        F.avg((c(exposure) < 1.0).cast("double")).alias("time_in_cash_pct"),
    )


def overlay_metrics(nav: DataFrame) -> DataFrame:
    """Metrics of an overlay's own NAV (date, w, nav): growth, drawdown, Sharpe, share invested, switches."""
    base = nav_metrics(nav.select("date", c("nav").alias("equity"))).select("cagr", c("max_drawdown").alias("max_dd"), c("dd_days").alias("max_dd_days"), "calmar", "sharpe")
    moved = nav.select("w", (c("w") != F.lag("w").over(one_series())).cast("long").alias("_m"))
    extra = moved.agg(F.avg("w").alias("realized_avg_fraction"), F.coalesce(F.sum("_m"), F.lit(0)).alias("n_rebalances"))
    return base.withColumns({k: extra.select(k).scalar() for k in ("realized_avg_fraction", "n_rebalances")})


def relative_metrics(nav: DataFrame, strategy: str = "equity", benchmark: str = "benchmark") -> DataFrame:
    """Ratios, excess growth, information ratio, captures, correlation and beta on common days."""
    both = nav.filter(c(strategy).isNotNull() & c(benchmark).isNotNull())
    w = one_series()
    df = both.select(
        "date",
        (F.try_divide(c(strategy), F.lag(strategy).over(w)) - 1).alias("s"),
        (F.try_divide(c(benchmark), F.lag(benchmark).over(w)) - 1).alias("b"),
    )
    x = c("s") - c("b")
    up, down = c("b") > 0, c("b") < 0
    sd = F.stddev_samp(x)
    stats = df.agg(
        F.count("*").alias("n_overlap"),
        F.when(sd > 0, F.avg(x) / sd * F.sqrt(F.lit(float(TRADING_DAYS)))).otherwise(0.0).alias("information_ratio"),
        F.try_divide(F.avg(F.when(up, c("s"))), F.avg(F.when(up, c("b")))).alias("up_capture"),
        F.try_divide(F.avg(F.when(down, c("s"))), F.avg(F.when(down, c("b")))).alias("down_capture"),
        F.corr("s", "b").alias("correlation"),
        F.try_divide(F.covar_samp("s", "b"), F.var_samp("b")).alias("beta"),
    )
    for tag, column in (("strategy", strategy), ("benchmark", benchmark)):
        m = nav_metrics(both, column)
        stats = stats.withColumns({f"{tag}_{k}": m.select(k).scalar() for k in ("cagr", "max_drawdown", "calmar")})
    return stats.withColumns(
        {
            "excess_cagr": c("strategy_cagr") - c("benchmark_cagr"),
            "calmar_ratio": F.try_divide("strategy_calmar", "benchmark_calmar"),
            "max_dd_ratio": F.try_divide("strategy_max_drawdown", "benchmark_max_drawdown"),
        }
    )


def decision(metrics: DataFrame, go_fraction: float = 0.80) -> DataFrame:
    """GO / marginal / NO-GO from (c_strat, c_primary, c_floor)."""
    verdict = (
        F.when(c("c_strat") < c("c_floor"), "NO-GO").when(c("c_strat") >= go_fraction * c("c_primary"), "GO").otherwise("GO (marginal)")
    )
    return metrics.withColumn("decision", verdict)


def drawdown_episodes(nav: DataFrame, column: str = "equity", min_depth: float = 0.08) -> DataFrame:
    """Peak, trough and recovery of each deep drawdown; an open one ends on the last day.

    Days under one running maximum form an island; its first day is the peak.
    """
    w = one_series().rowsBetween(Window.unboundedPreceding, 0)
    df = nav.select("date", c(column).alias("v")).withColumn("_peak", F.max("v").over(w))
    df = df.withColumn("_isle", F.sum((c("v") >= c("_peak")).cast("int")).over(w))
    isles = df.groupBy("_isle").agg(
        F.min("date").alias("peak_date"),
        F.max("v").alias("_top"),
        F.min(F.struct("v", "date")).alias("_low"),
        F.max("date").alias("_end"),
    )
    order = Window.partitionBy(F.lit(0)).orderBy("_isle")
    isles = isles.withColumn("end_date", F.coalesce(F.lead("peak_date").over(order), c("_end")))
    depth = c("_low.v") / c("_top") - 1
    return isles.filter(-depth >= min_depth).select("peak_date", c("_low.date").alias("trough_date"), "end_date", depth.alias("depth"))


def episode_edges(episodes: DataFrame, nav: DataFrame, a: str, b: str) -> DataFrame:
    """Log-return edge of one NAV over another across each episode."""
    at = nav.select("date", c(a).alias("_a"), c(b).alias("_b"))
    start = at.select(c("date").alias("peak_date"), c("_a").alias("_a0"), c("_b").alias("_b0"))
    end = at.select(c("date").alias("end_date"), c("_a").alias("_a1"), c("_b").alias("_b1"))
    edge = F.log(c("_a1") / c("_a0")) - F.log(c("_b1") / c("_b0"))
    return episodes.join(start, "peak_date").join(end, "end_date").select("peak_date", "end_date", edge.alias("edge"))


def rebased(nav: DataFrame, column: str = "benchmark", base: str = "equity") -> DataFrame:
    """Index scaled to the NAV at its first known level."""
    w = one_series().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = c(column).isNotNull()
    return nav.withColumn(
        "index_nav",
        c(column) / F.first(column, ignorenulls=True).over(w) * F.first(F.when(known, c(base)), ignorenulls=True).over(w),
    )


def cumulative_excess(nav: DataFrame) -> DataFrame:
    """NAV growth less index growth since the first day both exist."""
    w = one_series().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    both = c("equity").isNotNull() & c("benchmark").isNotNull()
    first = lambda k: F.first(F.when(both, c(k)), ignorenulls=True).over(w)
    return nav.select("date", F.when(both, c("equity") / first("equity") - c("benchmark") / first("benchmark")).alias("excess"))


def tracking_error(nav: DataFrame) -> DataFrame:
    """Daily return difference, its running sum and the annualised deviation."""
    w = one_series()
    diff = F.try_divide(c("equity"), F.lag("equity").over(w)) - F.try_divide(c("benchmark"), F.lag("benchmark").over(w))
    df = nav.select("date", diff.alias("diff"))
    te = df.agg(F.stddev_samp("diff") * F.sqrt(F.lit(float(TRADING_DAYS)))).scalar()
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return df.select("date", "diff", F.sum("diff").over(run).alias("cumulative"), te.alias("tracking_error"))


def annual_drag(index: DataFrame, drag: float) -> DataFrame:
    """Index series under a constant annual cost."""
    start = index.agg(F.min("date")).scalar()
    return index.select("date", (c("level") * F.pow(F.lit(1.0 - drag), F.datediff("date", start) / YEAR_DAYS)).alias("level"))


def annualised_turnover(per_rebalance: DataFrame, column: str = "turnover", absurd_pct: float = 1000.0) -> DataFrame:
    years = F.datediff(F.max("date"), F.min("date")) / YEAR_DAYS
    return per_rebalance.agg((F.sum(column) / years * 100).alias("annualized_pct")).withColumn(
        "absurd", c("annualized_pct") > absurd_pct
    )


def capacity(avg_trade: Column, adv_floor: float) -> Column:
    return avg_trade / adv_floor * 100


def period_metrics(nav: DataFrame, periods: DataFrame) -> DataFrame:
    """NAV metrics inside each named period (name, start, end).

    The periods travel as one array, so a day is matched to its periods without a
    join that has no equal key.
    """
    table = periods.agg(F.collect_list(F.struct("name", "start", "end"))).scalar()
    hit = F.filter("_periods", lambda p: c("date").between(p["start"], p["end"]))
    tagged = nav.withColumn("_periods", table).select(F.explode(hit).alias("p"), "date", "equity")
    return nav_metrics(tagged.select("p.name", "date", "equity"), by=["name"])


def concentration_rule(period_calmars: DataFrame, limit: float = 5.0) -> DataFrame:
    """No positive period above ``limit`` times the mean of the other positive ones."""
    pos = period_calmars.filter(c("calmar") > 0)
    w = Window.partitionBy(F.lit(0))
    others = (F.sum("calmar").over(w) - c("calmar")) / (F.count("*").over(w) - 1)
    return pos.withColumn("_bad", F.coalesce(c("calmar") > limit * others, F.lit(False))).agg(
        F.coalesce(~F.max("_bad"), F.lit(True)).alias("passed"), F.count("*").alias("positive_periods")
    )


def fold_calmars(returns: DataFrame, folds: int, by: Sequence[str] = ("config",)) -> DataFrame:
    """Calmar of contiguous, equally sized slices of a return series; none becomes 0."""
    w = Window.partitionBy(*by).orderBy("date")
    n = F.count("*").over(Window.partitionBy(*by))
    df = returns.withColumns({"_i": F.row_number().over(w) - 1, "_n": n})
    edges = F.transform(F.sequence(F.lit(1), F.lit(folds - 1)), lambda k: F.floor(k * c("_n") / folds))
    df = df.withColumn("fold", F.size(F.filter(edges, lambda e: e <= c("_i"))))
    keys = [*by, "fold"]
    part = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_eq", F.exp(F.sum(F.log1p("ret")).over(part)))
    df = df.withColumn("_dd", c("_eq") / F.max("_eq").over(part) - 1)
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.max_by("_eq", "date").alias("_last"), (-F.min("_dd")).alias("_mdd"))
    calmar = (F.pow("_last", float(TRADING_DAYS) / c("n")) - 1) / c("_mdd")
    return out.select(*keys, F.when((c("n") >= 2) & (c("_mdd") > 0), calmar).otherwise(0.0).alias("calmar"))


def robustness(folds: DataFrame) -> DataFrame:
    """(Weighted Sharpe - its deviation) x 0.7 + weighted Calmar x 0.3 per config."""
    w = c("weight")
    return folds.groupBy("config").agg(
        (
            (F.try_divide(F.sum(w * c("sharpe")), F.sum(w)) - F.stddev_pop("sharpe")) * 0.7 + F.try_divide(F.sum(w * c("calmar")), F.sum(w)) * 0.3
        ).alias("robustness")
    )


def top_configs(scores: DataFrame, n: int) -> DataFrame:
    return scores.orderBy(c("robustness").desc(), "config").limit(n)


def deflated_sharpe(returns: DataFrame, trials: int, by: Sequence[str] = ("config",)) -> DataFrame:
    """Sharpe less the maximum expected from that many skill-less trials."""
    mean_sd = returns.groupBy(*by).agg(F.avg("ret").alias("mu"), F.stddev_samp("ret").alias("sd"), F.count("ret").alias("n"))
    df = returns.join(mean_sd, list(by))
    z = F.try_divide(c("ret") - c("mu"), c("sd"))  # null without variance
    m = df.groupBy(*by, "mu", "sd", "n").agg(F.avg(F.pow(z, 3)).alias("skew"), (F.avg(F.pow(z, 4)) - 3).alias("kurt"))
    sr = F.try_divide("mu", "sd")
    var = F.try_divide(1 - c("skew") * sr + c("kurt") / 4 * sr * sr, c("n") - 1)
    quantile = NormalDist().inv_cdf
    most = (1 - EULER) * quantile(1 - 1 / trials) + EULER * quantile(1 - 1 / (trials * 2.718281828459045))
    noise = F.lit(most) * F.sqrt(F.greatest(var, F.lit(1e-12)))
    return m.select(*by, ((sr - noise) * F.sqrt(F.lit(float(TRADING_DAYS)))).alias("deflated_sharpe"), (sr * F.sqrt(F.lit(float(TRADING_DAYS)))).alias("sharpe"))


def overfit_probability(matrix: DataFrame, folds: Sequence) -> DataFrame:
    """Share of half-splits whose in-sample winner falls below the out-of-sample median.

    ``matrix`` is (config, fold, metric).  A split is a bit mask over the folds; each row grows its
    masks fold by fold and drops those that can no longer hold half of them, so no list of splits
    is built anywhere.  n folds have n over n/2 splits, the work that the measure asks for.
    """
    n, half = len(folds), len(folds) // 2
    if not 2 <= n <= 62:
        raise ValueError("between 2 and 62 folds")  # bits of a long
    place = F.array_position(F.array(*map(F.lit, folds)), c("fold")).cast("int") - 1
    df = matrix.select("config", "metric", place.alias("_at"), F.lit(0).cast("long").alias("split"))
    for k in range(n):
        taken = F.bit_count("split")
        df = df.withColumn("split", F.explode(F.array(c("split"), c("split") + F.lit(1 << k).cast("long"))))
        df = df.filter((taken <= half) & (taken + (n - 1 - k) >= half))
    df = df.withColumn("inside", F.getbit("split", F.greatest("_at", F.lit(0))).cast("boolean") & (c("_at") >= 0))
    per = df.groupBy("split", "config").agg(
        F.avg(F.when(c("inside"), c("metric"))).alias("is_avg"), F.avg(F.when(~c("inside"), c("metric"))).alias("oos_avg")
    )
    # One evaluation for both sides: read twice, sums in another order would put the winner below itself.
    best = F.max(F.struct("is_avg", (-c("config")).alias("_c"), "oos_avg")).over(Window.partitionBy("split"))
    omega = per.withColumn("_o", best["oos_avg"]).groupBy("split").agg(
        F.avg((c("oos_avg") < c("_o")).cast("double")).alias("omega")
    )
    return omega.agg(F.avg((c("omega") < 0.5).cast("double")).alias("pbo"), F.count("*").alias("splits"))


def plateau(points: DataFrame, axes: Sequence[str], metric: str = "calmar", tolerance: float = 0.85) -> DataFrame:
    """Grid winner against its direct neighbours on each axis."""
    ranked = points
    for a in axes:
        ranked = ranked.withColumn(f"_{a}", F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy(a)))
    win = ranked.agg(F.max(F.struct(c(metric), *[c(f"_{a}") for a in axes])).alias("w"))
    for a in axes:
        ranked = ranked.withColumn(f"_w{a}", win.select(f"w._{a}").scalar())
    best = win.select(f"w.{metric}").scalar()
    steps = sum(F.abs(c(f"_{a}") - c(f"_w{a}")) for a in axes)
    near = ranked.filter(steps == 1).agg(F.min(metric).alias("min_neighbour"), F.count("*").alias("neighbours"))
    return near.withColumn("winner", best).withColumn(
        "has_plateau", F.coalesce((c("winner") > 0) & (c("min_neighbour") >= tolerance * c("winner")), F.lit(False))
    )


def parameter_grid(axes: dict[str, Sequence[float]], base: DataFrame) -> DataFrame:
    """All combinations of the axes laid over a seed row; the grid is as large as its axes."""
    out = base
    for name, values in axes.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


def numbered(names: DataFrame, name: str, out: str) -> DataFrame:
    """Numbers from 1 in the order of (md5, name): counts of 4,096 hash ranges, then numbers inside each range."""
    df = names.withColumn("_h", F.md5(c(name).cast("string"))).withColumn("_b", F.substring("_h", 1, 3))
    counts = df.groupBy("_b").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy("_h", name))
    return df.withColumn("_i", inside).join(F.broadcast(offsets), "_b").withColumn(out, c("_o") + c("_i")).drop("_h", "_b", "_i", "_o")


def floyd_sample(n: Column, k: int, *seed: Column) -> Column:
    """Array of min(k, n) distinct numbers of 1..n, each subset as likely as any other, by Floyd's rule."""

    def step(taken: Column, j: Column) -> Column:
        draw = F.conv(F.substring(scan.seeded_order(*seed, j), 1, 15), 16, 10).cast("long") % j + 1
        return F.array_append(taken, F.when(F.array_contains(taken, draw), j).otherwise(draw))

    ends = F.sequence(F.greatest(n - (k - 1), F.lit(1)).cast("long"), n.cast("long"))
    none = F.array().cast("array<bigint>")
    return F.when((n > 0) & F.lit(k > 0), F.aggregate(ends, none, step)).otherwise(none)


def subset_retention(contributions: DataFrame, draws: int, drop: int, seed: int) -> DataFrame:
    """Share of the total left after dropping random names, over seeded draws.

    Each draw picks ``drop`` numbers and they are joined with the numbered names: draws x drop rows,
    however many names there are.
    """
    whole = contributions.agg(F.sum("pnl").alias("total"), F.count("*").alias("names"))
    each = whole.select("total", "names", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    picks = each.select("draw", "total", F.explode(floyd_sample(c("names"), drop, F.lit(seed), c("draw"))).alias("_k"))
    gone = picks.join(numbered(contributions, "isin", "_k"), "_k").groupBy("draw", "total").agg(F.sum("pnl").alias("lost"))
    left = gone.select("draw", F.try_divide(c("total") - c("lost"), c("total")).alias("retained"))
    p = F.percentile("retained", F.array(F.lit(0.5), F.lit(0.05)))
    return left.agg(p.alias("p"), F.count("*").alias("draws")).select("draws", c("p")[0].alias("median"), c("p")[1].alias("p5"))
