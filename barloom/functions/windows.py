"""Frame helpers over bars: rolling measures with a full-window rule, ranks, carry-forward."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

TRADING_DAYS = 252
c = F.col


def bars_window(*keys: str, order: str | Sequence[str] = "date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def one_series(order: str | Sequence[str] = "date") -> WindowSpec:
    """Window over a table that has one row per day (calendar, index, NAV).

    Such a table has a few thousand rows at any data volume, so one task is right.
    """
    return Window.partitionBy(F.lit(0)).orderBy(order)


def trailing(keys: Sequence[str], n: int, order: str | Sequence[str] = "date", end: int = 0) -> WindowSpec:
    """The ``n`` rows that end ``-end`` rows before the current one."""
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(end - n + 1, end)


def running(keys: Sequence[str], order: str | Sequence[str] = "date", end: int = 0) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, end)


def sma(x: Column, n: int, keys: Sequence[str], order: str | Sequence[str] = "date") -> Column:
    """Mean of the last n values; null until n are there."""
    w = trailing(keys, n, order)
    return F.when(F.count(x).over(w) == n, F.avg(x).over(w))


def running_mean(x: Column, keys: Sequence[str], order: str | Sequence[str] = "date") -> Column:
    """Mean of all values so far: at the n-th value it is the seed of an n-bar average."""
    return F.avg(x).over(running(keys, order))


def with_frame_sums(df: DataFrame, items: dict[str, tuple[Column, int]], keys: Sequence[str], order: str | Sequence[str] = "date") -> DataFrame:
    """Add ``name`` (sum) and ``name_n`` (non-null count) over the last n rows for long frames.

    Two passes over one sort: running totals, then each minus its value n rows back.
    Spark would otherwise re-read the whole frame for every row.
    """
    ahead, w = running(keys, order), Window.partitionBy(*keys).orderBy(order)
    totals = {}
    for name, (x, _) in items.items():
        totals[f"_t_{name}"] = F.sum(F.coalesce(x, F.lit(0.0))).over(ahead)
        totals[f"_c_{name}"] = F.count(x).over(ahead)
    df = df.withColumns(totals)
    out = {}
    for name, (_, n) in items.items():
        out[name] = c(f"_t_{name}") - F.coalesce(F.lag(f"_t_{name}", n).over(w), F.lit(0.0))
        out[f"{name}_n"] = c(f"_c_{name}") - F.coalesce(F.lag(f"_c_{name}", n).over(w), F.lit(0))
    return df.withColumns(out).drop(*totals)


STEP = 6  # frames that one pass of the rolling extremes puts together


def with_rolling_extremes(
    df: DataFrame, x: str, frames: dict[str, tuple[str, int, int]], keys: Sequence[str], order: str | Sequence[str] = "date"
) -> DataFrame:
    """Rolling max/min over long frames by sixes: a frame of 6k rows is six frames of k, lags of one another.

    ``frames`` maps a name to ("max" | "min", rows, rows back).  Every pass is a set of lags on one shared
    sort, so a frame costs a few lags for each power of six instead of its rows for each bar; the shift
    back is a part of the last lags.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    pick = {"max": F.greatest, "min": F.least}
    kinds = sorted({k for k, _, _ in frames.values()})

    def joined(kind: str, size: int, rows: int, back: int = 0) -> Column:
        """Extreme of ``rows`` rows that end ``back`` rows ago, from those of ``size`` rows (the last two may overlap)."""
        lags = sorted({*range(0, rows - size, size), rows - size})
        parts = [F.lag(f"_{kind}{size}", n + back).over(w) if n + back else c(f"_{kind}{size}") for n in lags]
        return pick[kind](*parts) if len(parts) > 1 else parts[0]

    size, left, made = 1, dict(frames), []
    df = df.withColumns({f"_{k}1": F.col(x) for k in kinds})
    while left:
        made += [f"_{k}{size}" for k in kinds]
        step = {name: joined(k, size, n, back) for name, (k, n, back) in left.items() if n <= size * STEP}
        left = {name: frame for name, frame in left.items() if name not in step}
        if left:
            step |= {f"_{k}{size * STEP}": joined(k, size, size * STEP) for k in kinds}
        df = df.withColumns(step)
        size *= STEP
    return df.drop(*made)


def median_of(values: Column) -> Column:
    """Median of a small array: mean of its two middle values."""
    a = F.sort_array(values)
    n = F.size(a)
    return (F.get(a, F.floor((n - 1) / 2).cast("int")) + F.get(a, F.floor(n / 2).cast("int"))) / 2


def rolling_median(x: Column, n: int, keys: Sequence[str], min_rows: int = 1) -> Column:
    """Median of the last n values; the frame's values are collected once per row and sorted."""
    w = trailing(keys, n)
    return F.when(F.count(x).over(w) >= min_rows, median_of(F.collect_list(x).over(w)))


def skip_return(x: Column, skip: int, lookback: int, w: WindowSpec) -> Column:
    """x[t-skip] / x[t-lookback] - 1, null on a zero base."""
    base = F.lag(x, lookback).over(w)
    top = F.lag(x, skip).over(w) if skip else x
    return F.when(base != 0, top / base - 1)


def pct_rank_avg(x: Column, by: Sequence[str]) -> Column:
    """Percentile rank in (0, 1], tied values sharing their mean rank; null stays null."""
    ranked = Window.partitionBy(*by).orderBy(x.asc_nulls_last())
    group = Window.partitionBy(*by)
    ties = Window.partitionBy(*by, x)
    mean_rank = F.rank().over(ranked) + (F.count(x).over(ties) - 1) / 2.0
    return F.when(x.isNotNull(), mean_rank / F.count(x).over(group))


def avg_rank(x: Column, by: Sequence[str]) -> Column:
    ranked = Window.partitionBy(*by).orderBy(x.asc_nulls_last())
    return F.when(
        x.isNotNull(),
        F.rank().over(ranked) + (F.count(x).over(Window.partitionBy(*by, x)) - 1) / 2.0,
    )


def carry_forward(marker: Column, w: WindowSpec, default: Column) -> Column:
    """Two-state machine whose set and reset marks exclude each other."""
    return F.coalesce(F.last(marker, ignorenulls=True).over(w), default)


def sure(condition: Column) -> Column:
    """A comparison with a missing value is false."""
    return F.coalesce(condition, F.lit(False))
