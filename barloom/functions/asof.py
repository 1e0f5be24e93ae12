"""As-of joins without pairing: both sides meet in one sorted window per key.

The left side is first reduced to its distinct (key, day) pairs, so a key that owns
a third of all rows costs one row per day in the window; the full left side then
meets the answer in an equi-join, which adaptive execution can split when skewed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_on: str,
    right_on: str,
    cols: Sequence[str],
    *,
    strict: bool = False,
    forward: bool = False,
    unique_left: bool = False,
) -> DataFrame:
    """Give each left row the nearest right row at or before (or after) its time.

    ``right`` must be unique on (keys, right_on).  ``strict`` excludes equal times,
    ``forward`` looks to later times.  Rows without a match get nulls.
    ``unique_left`` states that left has one row per (keys, left_on).
    """
    payload = F.struct(*[F.col(c) for c in cols])
    points = left if unique_left else left.select(*keys, left_on).distinct()
    left_side, right_side = (1, 0) if not strict else (0, 1)
    if forward:
        left_side, right_side = (0, 1) if not strict else (1, 0)
    probe = points.withColumns(
        {"_ts": F.col(left_on), "_side": F.lit(left_side), "_probe": F.lit(True)}
    )
    build = right.select(
        *keys,
        F.col(right_on).alias("_ts"),
        F.lit(right_side).alias("_side"),
        F.lit(False).alias("_probe"),
        payload.alias("_hit"),
    )
    both = probe.unionByName(build, allowMissingColumns=True)
    part = [F.col(k) for k in keys] or [F.lit(0)]
    if forward:
        w = Window.partitionBy(*part).orderBy(F.col("_ts").desc(), F.col("_side").desc())
    else:
        w = Window.partitionBy(*part).orderBy("_ts", "_side")
    w = w.rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_got", F.last("_hit", ignorenulls=True).over(w)).filter("_probe")
    found = found.select(
        *points.columns, *[F.col("_got").getField(c).alias(c) for c in cols]
    )
    if unique_left:
        return found
    return left.join(found, [*keys, left_on], "left")
