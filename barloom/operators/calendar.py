"""Trading calendars and date arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.asof import asof_join
from barloom.functions.windows import one_series
from barloom.operators.indicators import period_end

c = F.col


def trading_days(bars: DataFrame) -> DataFrame:
    return bars.select("date").distinct()


def anchors(calendar: DataFrame, cadence: str) -> DataFrame:
    """Last trading day of each month, quarter, half year or week (to Friday)."""
    d = c("date")
    group = {
        "weekly": period_end(d, "W-FRI"),
        "monthly": F.trunc(d, "month"),
        "quarterly": F.trunc(d, "quarter"),
        "half-yearly": F.make_date(F.year(d), F.when(F.month(d) <= 6, 1).otherwise(7), F.lit(1)),
    }[cadence]
    return calendar.groupBy(group.alias("_g")).agg(F.max("date").alias("date")).select("date")


def review_days(calendar: DataFrame, month_days=((1, 31), (7, 31))) -> DataFrame:
    """Last trading day on or before each fixed calendar day inside the calendar's span."""
    span = calendar.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    years = span.select("a", "b", F.explode(F.sequence(F.year("a"), F.year("b"))).alias("y"))
    fixed = years.select(
        "a", "b", F.explode(F.array(*[F.make_date("y", F.lit(m), F.lit(d)) for m, d in month_days])).alias("anchor")
    ).filter(c("anchor").between(c("a"), c("b")))
    found = asof_join(fixed.select("anchor"), calendar.select("date"), [], "anchor", "date", ["date"], unique_left=True)
    return found.select("date").distinct()


def nearest_day(requested: DataFrame, calendar: DataFrame) -> DataFrame:
    """Calendar day nearest to each requested day; the earlier one on ties."""
    back = asof_join(requested, calendar.select(c("date").alias("b"), c("date").alias("_d")), [], "wanted", "_d", ["b"], unique_left=True)
    both = asof_join(back, calendar.select(c("date").alias("f"), c("date").alias("_d")), [], "wanted", "_d", ["f"], forward=True, unique_left=True)
    db, df = F.datediff("wanted", "b"), F.datediff("f", "wanted")
    pick = F.when(c("f").isNull() | (db <= df), c("b")).otherwise(c("f"))
    return both.select("wanted", F.coalesce(pick, c("f")).alias("date"))


def roll_forward(d: Column) -> Column:
    """Saturday and Sunday to Monday."""
    w = F.weekday(d)
    return F.when(w == 5, F.date_add(d, 2)).when(w == 6, F.date_add(d, 1)).otherwise(d)


def minus_two_business_days(d: Column) -> Column:
    """d must be a weekday."""
    return F.date_sub(d, F.when(F.weekday(d) <= 1, 4).otherwise(2))


def weekday_lag(reference: Column, today: Column) -> Column:
    """Weekdays after ``reference`` up to ``today``, in closed form; never negative."""

    def before(d: Column) -> Column:  # weekdays from a fixed Monday up to and including d
        n = F.datediff(d, F.lit("1970-01-05").cast("date"))
        return F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)) + 1, F.lit(5))

    return F.greatest(before(today) - before(reference), F.lit(0))


def months_elapsed(start: Column, today: Column) -> Column:
    return (
        (F.year(today) - F.year(start)) * 12
        + (F.month(today) - F.month(start))
        + (F.dayofmonth(today) - F.dayofmonth(start)) / 30.0
    )


def walk_forward(a: Column, b: Column, min_is_months: int = 24, oos_months: int = 6) -> Column:
    """Array of fold bounds between two dates: expanding in-sample, fixed out-of-sample."""
    first = F.add_months(a, min_is_months)
    starts = F.sequence(first, b, F.make_ym_interval(F.lit(0), F.lit(oos_months)))
    return F.filter(
        F.transform(
            starts,
            lambda s: F.struct(
                a.alias("is_start"),
                F.date_sub(s, 1).alias("is_end"),
                s.alias("oos_start"),
                F.date_sub(F.add_months(s, oos_months), 1).alias("oos_end"),
            ),
        ),
        lambda f: f["oos_end"] <= b,
    )


def ordinals(calendar: DataFrame) -> DataFrame:
    return calendar.withColumn("ord", F.row_number().over(one_series()))
