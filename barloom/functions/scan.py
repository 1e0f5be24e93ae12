"""Ordered scans that no hot key can funnel into one task.

A key may own a third of all rows, so nothing here sorts a whole key's raw rows.
Rows are combined per (key, day), and a large day per range of its rows; only that
table is scanned in order, and the answer returns to the rows by an equi-join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 200  # linear ranges of a column
OCTAVE = 256  # logarithmic ranges of a doubling
RANGE_ROWS = 200_000  # rows of one key and day that a task may sort


def day_ranges(df: DataFrame, keys: Sequence[str], day: str, first: str, rows: int = RANGE_ROWS) -> DataFrame:
    """``_r``: the number of a row's range in its (key, day), in the order of the numeric column ``first``.

    A day of more than ``rows`` rows is cut between its least and greatest value into ranges of
    equal width, about ``rows`` rows each where the values are spread evenly (hashed ids are).
    Count, least and greatest value are the same however often they are computed, so ranges are.
    """
    stats = df.groupBy(*keys, day).agg(F.count("*").alias("_rows"), F.min(first).alias("_lo"), F.max(first).alias("_hi"))
    big = stats.filter(F.col("_rows") > rows)
    share = (F.col(first) - F.col("_lo")).cast("double") / (F.col("_hi") - F.col("_lo") + 1)
    number = F.floor(share * F.ceil(F.col("_rows") / rows)).cast("int")
    return df.join(big, [*keys, day], "left").withColumn("_r", F.coalesce(number, F.lit(0))).drop("_rows", "_lo", "_hi")


def number_rows(df: DataFrame, keys: Sequence[str], day: str, order: Sequence[str], out: str, rows: int = RANGE_ROWS) -> DataFrame:
    """Exact row number within a key by (day, order): counted per range of a day, offset by all ranges before.

    ``order`` starts with a numeric column; no task sorts more than one range.
    """
    unit = [*keys, day, "_r"]
    df = day_ranges(df, keys, day, order[0], rows)
    counts = df.groupBy(*unit).agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*keys).orderBy(day, "_r").rowsBetween(Window.unboundedPreceding, -1)
    offset = counts.select(*unit, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy(*unit).orderBy(*order)
    return (
        df.withColumn("_i", F.row_number().over(inside))
        .join(offset, unit)
        .withColumn(out, F.col("_o") + F.col("_i"))
        .drop("_o", "_i", "_r")
    )


def next_row(
    df: DataFrame, keys: Sequence[str], day: str, order: Sequence[str], cols: Sequence[str], out: str, rows: int = RANGE_ROWS
) -> DataFrame:
    """Struct of the following row of the key; the last row of a range meets the first of the next range or day."""
    unit = [*keys, day, "_r"]
    df = day_ranges(df, keys, day, order[0], rows)
    here = F.struct(F.col(day), *row_fields(order, cols))
    firsts = df.groupBy(*unit).agg(F.min(here).alias("_first"))
    w = Window.partitionBy(*keys).orderBy(day, "_r")
    nxt = firsts.select(*unit, F.lead("_first").over(w).alias("_next"))
    inside = Window.partitionBy(*unit).orderBy(*order)
    return (
        df.withColumn("_here", F.lead(here).over(inside))
        .join(nxt, unit)
        .withColumn(out, F.coalesce("_here", "_next"))
        .drop("_here", "_next", "_r")
    )


def row_fields(order: Sequence[str], cols: Sequence[str]) -> list[Column]:
    return [F.col(x) for x in dict.fromkeys((*order, *cols))]


def range_number(df: DataFrame, value: str) -> Column:
    """A number that never falls as ``value`` rises: its place on a logarithmic plus that on a linear scale.

    The logarithm gives OCTAVE numbers for each doubling whatever the values are; least and greatest
    finite value, a part of the same plan, give BUCKETS equal widths, for values crowded inside one
    doubling. Both are the same however often they are computed. Nulls come first, NaN last.
    """
    v = F.col(value).cast("double")
    finite = F.when(F.abs(v) < 1e300, v)
    ends = df.agg(F.min(finite).alias("lo"), F.max(finite).alias("hi"))
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    log = F.greatest(F.lit(-745.0), F.least(F.lit(710.0), F.ln(F.abs(v))))
    coarse = F.signum(v) * (F.floor(log * (OCTAVE / 0.6931471805599453)) + OCTAVE * 1100)
    fine = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(float(BUCKETS)), F.try_divide(v - lo, hi - lo) * BUCKETS)))
    number = F.when(F.isnan(v), OCTAVE * 5000.0).when(v == 0, 0.0).otherwise(coarse) + F.coalesce(fine, F.lit(0))
    return F.coalesce(number, F.lit(-OCTAVE * 5000.0)).cast("long")


def prefix_sums(df: DataFrame, value: str, sums: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Sums of all rows with a smaller value, over a table with one row per (group, value).

    Values fall into ranges by ``range_number``; whatever the ranges, the result is exact: totals
    of the ranges before, plus a window inside the range. No job runs while the plan is built.
    """
    keys = [*by, "_b"]
    df = df.withColumn("_b", range_number(df, value))
    totals = df.groupBy(*keys).agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    group = [F.col(k) for k in by] or [F.lit(0)]
    lower = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, *[F.coalesce(F.sum(f"_t_{s}").over(lower), F.lit(0)).alias(f"_o_{s}") for s in sums])
    inside = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = df.join(offsets, keys)
    for s in sums:
        out = out.withColumn(f"before_{s}", F.col(f"_o_{s}") + F.coalesce(F.sum(s).over(inside), F.lit(0)))
    return out.drop("_b", *[f"_o_{s}" for s in sums])


def quantiles(df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Exact interpolated quantiles per group without one task seeing all its values."""
    grouped = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    ranked = prefix_sums(grouped, "_v", ["_n"], by)
    totals = grouped.groupBy(*by).agg(F.sum("_n").alias("_total")) if by else None
    if totals is None:
        ranked = ranked.withColumn("_total", grouped.agg(F.sum("_n")).scalar())
    else:
        ranked = ranked.join(totals, list(by))

    def at(position: Column) -> Column:
        inside = (F.col("before__n") <= position) & (position < F.col("before__n") + F.col("_n"))
        return F.max(F.when(inside, F.col("_v")))

    aggs = []
    for name, p in probs.items():
        pos = (F.col("_total") - 1) * p
        low, high = at(F.floor(pos)), at(F.ceil(pos))
        share = F.max(pos - F.floor(pos))
        aggs.append((low + (high - low) * share).alias(name))
    return ranked.groupBy(*by).agg(*aggs) if by else ranked.agg(*aggs)


def seeded_order(*parts: Column) -> Column:
    """Reproducible random key of a row for given seeds."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
