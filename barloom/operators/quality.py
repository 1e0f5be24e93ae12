"""Data-quality checks; each returns the checked things with a ``failed`` flag."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.asof import asof_join
from barloom.functions.windows import rolling_median, sure
from barloom.operators import identity

c = F.col
# Price ratios a missed split or bonus leaves behind.
SPLIT_RATIOS = (1 / 2, 1 / 3, 1 / 4, 1 / 5, 1 / 10)


def violations(checked: DataFrame) -> DataFrame:
    return checked.filter("failed").drop("failed")


def known_events(prices: DataFrame, known: DataFrame, max_gap: float = 0.40) -> DataFrame:
    """Close gap and factor ratio across documented ex-dates; known: (isin, ex_date, expected, tol)."""
    side = prices.select("isin", "date", "close", "adj_factor")
    before = asof_join(known, side.select("isin", "date", c("close").alias("c0"), c("adj_factor").alias("f0")),
                       ["isin"], "ex_date", "date", ["c0", "f0"], strict=True)
    both = asof_join(before, side.select("isin", "date", c("close").alias("c1"), c("adj_factor").alias("f1")),
                     ["isin"], "ex_date", "date", ["c1", "f1"], forward=True)
    both = both.filter(c("c0").isNotNull() & c("c1").isNotNull())
    gap = F.abs(c("c1") - c("c0")) / c("c0")
    ratio = c("f0") / c("f1")
    moved = F.abs(c("f0") - c("f1")) > 1e-8 + 1e-6 * F.abs(c("f1"))
    failed = sure((c("c0") > 0) & (gap > max_gap)) | sure((c("f1") > 0) & moved & (F.abs(ratio - c("expected")) > c("tol")))
    return both.select("isin", "ex_date", gap.alias("gap"), ratio.alias("ratio"), failed.alias("failed"))


def survivorship(symbol_map: DataFrame, today, days: int = 365) -> DataFrame:
    """Count of ids gone for a while; a panel of survivors only is the failure."""
    last = symbol_map.groupBy("isin").agg(F.max("last_date").alias("last_date"))
    return last.agg(
        F.count("*").alias("ids"),
        F.sum((F.datediff(today, c("last_date")) > days).cast("long")).alias("delisted"),
    ).withColumn("failed", c("delisted") == 0)


def rename_overlap(symbol_map: DataFrame) -> DataFrame:
    """Symbols of one id must follow each other in time."""
    w = Window.partitionBy("isin").orderBy("first_date", "symbol")
    return symbol_map.withColumn("next_first", F.lead("first_date").over(w)).filter(c("next_first").isNotNull()).select(
        "isin", "symbol", (c("next_first") <= c("last_date")).alias("failed")
    )


def causal_adv(prices: DataFrame, rtol: float = 1e-6) -> DataFrame:
    """Stored adv_20 against the causal rolling median, every id."""
    want = rolling_median(c("traded_value"), 20, ["isin"])
    df = prices.withColumn("_want", want)
    return df.select("isin", "date", sure(F.abs(c("adv_20") - c("_want")) > 1e-8 + rtol * F.abs(c("_want"))).alias("failed"))


def total_return_growth(prices: DataFrame) -> DataFrame:
    """Total-return growth may not fall behind price growth."""
    df = prices.groupBy("isin").agg(
        F.count("*").alias("n"),
        (F.max_by("close", "date") / F.min_by("close", "date")).alias("price_growth"),
        (F.max_by("close_tr", "date") / F.min_by("close_tr", "date")).alias("tr_growth"),
    )
    return df.filter(c("n") >= 2).select(
        "isin", "price_growth", "tr_growth", (c("tr_growth") < c("price_growth") - 1e-6).alias("failed")
    )


def unadjusted_actions(prices: DataFrame, tol: float = 0.10) -> DataFrame:
    """Clean-ratio drops on days whose factors stayed flat."""
    w = Window.partitionBy("isin").orderBy("date")
    prev = F.lag("close").over(w)
    ratio = F.when(prev > 0, c("close") / prev)
    flat = lambda f: F.abs(c(f) - F.lag(f).over(w)) <= 1e-8 + 1e-6 * F.abs(F.lag(f).over(w))
    df = prices.select("isin", "date", ratio.alias("ratio"), (flat("adj_factor") & flat("tr_factor")).alias("_flat"))
    hit = F.exists(F.array(*[F.lit(m) for m in SPLIT_RATIOS]), lambda m: F.abs(c("ratio") - m) <= tol * m)
    return df.filter(c("ratio").isNotNull()).select("isin", "date", "ratio", sure(c("_flat") & hit).alias("failed"))


def succession_coverage(pairs: DataFrame, prices: DataFrame) -> DataFrame:
    """Each asserted link: the new leg is there and both legs carry the chain root."""
    ids = prices.groupBy("isin").agg(F.min("instrument_id").alias("id"))
    old = ids.select(c("isin").alias("old_isin"), c("id").alias("old_id"))
    new = ids.select(c("isin").alias("new_isin"), c("id").alias("new_id"))
    df = pairs.filter("asserted").join(old, "old_isin", "left").join(new, "new_isin", "left")
    good = c("new_id").isNotNull() & (F.coalesce("old_id", "old_isin") == c("root_isin")) & (c("new_id") == c("root_isin"))
    return df.select("old_isin", "new_isin", "root_isin", (~sure(good)).alias("failed"))


def silent_terminations(prices: DataFrame, pairs: DataFrame, k: int = 5, **kw) -> DataFrame:
    """Genuine terminations must have been silent for k market days at the edge."""
    gone = identity.terminations(prices, pairs, **kw).filter(c("subtype") != "data_gap_suspect")
    return gone.select("isin", "instrument_id").join(identity.silent_days(prices), "instrument_id").select(
        "isin", "silent_days", (c("silent_days") < k).alias("failed")
    )


def drift_guard(before: DataFrame, after: DataFrame, explained: DataFrame, tol: float = 1e-9) -> DataFrame:
    """Stored rows whose factor or close changed, split by whether an event explains it."""
    old = before.select("isin", "date", c("adj_factor").alias("f0"), c("close").alias("c0"))
    new = after.select("isin", "date", c("adj_factor").alias("f1"), c("close").alias("c1"))
    moved = (F.abs(c("f0") - c("f1")) > tol) | (F.abs(c("c0") - c("c1")) > tol)
    per_id = old.join(new, ["isin", "date"]).groupBy("isin").agg(F.sum(moved.cast("long")).alias("drifted_rows"))
    why = explained.select("isin").distinct().withColumn("explained", F.lit(True))
    out = per_id.join(why, "isin", "left").withColumn("explained", sure(c("explained")))
    return out.withColumn("failed", (c("drifted_rows") > 0) & ~c("explained"))


def store_coverage(prices: DataFrame, delist_days: int = 365) -> DataFrame:
    """Rows, ids, date range, share of weekdays without data, delisted ids."""
    days = prices.select("date").distinct()
    span = days.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    week = span.select(F.explode(F.sequence("a", "b")).alias("date")).filter(F.weekday("date") < 5)
    empty = week.join(days, "date", "left_anti").agg(F.count("*")).scalar()
    total = week.agg(F.count("*")).scalar()
    edge = days.agg(F.max("date")).scalar()
    ids = prices.groupBy("isin").agg(F.count("*").alias("n"), F.min("date").alias("a"), F.max("date").alias("b"))
    return ids.agg(
        F.sum("n").alias("rows"),
        F.count("*").alias("ids"),
        F.min("a").alias("first_date"),
        F.max("b").alias("last_date"),
        F.sum((F.datediff(edge, c("b")) > delist_days).cast("long")).alias("delisted"),
    ).withColumn("missing_weekday_pct", empty / total * 100)


def look_ahead(job: Callable[[DataFrame], DataFrame], source: DataFrame, cutoff, columns: Sequence[str],
               date: str = "date", factor: float = 5.0) -> DataFrame:
    """Results up to the cutoff that change when later rows are corrupted; must be empty."""
    later = c(date) > cutoff
    corrupt = source.withColumns({k: F.when(later, c(k) * factor).otherwise(c(k)) for k in columns})
    clean, dirty = (job(x).filter(c(date) <= cutoff) for x in (source, corrupt))
    return clean.exceptAll(dirty).unionByName(dirty.exceptAll(clean))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in one result and not the other; two runs of one job give none."""
    return a.exceptAll(b).unionByName(b.exceptAll(a))


def source_comparison(a: DataFrame, b: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Missing rates of two sources and their relative difference where both have a value."""
    left, right = a.select(*keys, c(column).alias("_a")), b.select(*keys, c(column).alias("_b"))
    diff = F.abs(c("_a") - c("_b")) / F.abs(c("_a"))
    return left.join(right, list(keys)).agg(
        F.avg(c("_a").isNull().cast("double")).alias("missing_a"),
        F.avg(c("_b").isNull().cast("double")).alias("missing_b"),
        F.avg(diff).alias("avg_rel_diff"),
        F.max(diff).alias("max_rel_diff"),
    )
