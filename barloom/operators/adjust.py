"""Corporate actions: parsing the feed, back-adjustment factors, adjusted prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import text

CAPITAL = ("split", "bonus")


def _day_number(column: str) -> Column:
    return F.datediff(F.col(column), F.lit("1970-01-01").cast("date"))


def parse_corporate_actions(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Feed rows (isin, symbol, subject, ex_date_raw, face_value) to events and rejects.

    One projection decides everything; the two outputs are filters of it.
    """
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit(""))
    df = records.select(
        blank("isin").alias("isin"),
        blank("symbol").alias("symbol"),
        blank("subject").alias("subject"),
        blank("ex_date_raw").alias("ex_date_raw"),
        F.col("face_value").try_cast("double").alias("face"),
    )
    df = df.withColumns(
        {
            "ex_date": F.try_to_timestamp("ex_date_raw", F.lit("dd-MMM-yyyy")).cast("date"),
            "type": text.classify_action(F.col("subject")),
        }
    )
    subject = F.col("subject")
    df = df.withColumns(
        {
            "ratio": F.when(F.col("type") == "split", text.split_multiplier(subject)).when(
                F.col("type") == "bonus", text.bonus_multiplier(subject)
            ),
            "dividend": F.when(F.col("type") == "dividend", text.dividend_amount(subject, F.col("face"))),
        }
    )
    value = F.coalesce("ratio", "dividend", F.lit(0.0))
    df = df.withColumn(
        "reason",
        F.when(F.col("isin") == "", "missing isin (cannot join)")
        .when(F.col("ex_date").isNull(), "unparseable ex-date")
        .when(F.col("type").isNull(), "no split/bonus/dividend keyword in subject")
        .when(value == 0, F.concat("type", F.lit(": could not parse value from subject"))),
    )
    events = (
        df.filter(F.col("reason").isNull())
        .select("isin", "symbol", "ex_date", "type", "ratio", "dividend", "subject")
        .dropDuplicates(["isin", "ex_date", "type", "ratio", "dividend"])
    )
    rejects = df.filter(F.col("reason").isNotNull()).select("isin", "symbol", "ex_date_raw", "subject", "reason")
    return events, rejects


def assign_events(raw: DataFrame, events: DataFrame) -> DataFrame:
    """Events per isin: its own, else same-symbol events inside its date span."""
    spans = raw.groupBy("isin").agg(
        F.min_by("symbol", "date").alias("symbol"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )
    own = events.join(spans.select("isin"), "isin", "left_semi")
    orphan = spans.join(events.select("isin").distinct(), "isin", "left_anti")
    bridged = (
        orphan.join(events.drop("isin"), "symbol")
        .filter(F.col("ex_date").between(F.col("first_date"), F.col("last_date")))
        .select(*own.columns)
    )
    return own.unionByName(bridged)


def factor_frame(raw: DataFrame, events: DataFrame) -> DataFrame:
    """Bars and events of each isin in one sorted window.

    Returns the union with, per event, its multiplier (dividends: 1 - D / last close
    strictly before the ex-date) and, per row, the product of the multipliers of all
    events strictly after it.
    """
    bars = raw.withColumns({"_day": _day_number("date"), "_close": F.col("close")})
    ev = events.select(
        "isin",
        _day_number("ex_date").alias("_day"),
        F.col("type").alias("_type"),
        F.col("ratio").alias("_ratio"),
        F.col("dividend").alias("_dividend"),
    )
    both = bars.unionByName(ev, allowMissingColumns=True)
    earlier = Window.partitionBy("isin").orderBy("_day").rangeBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("isin").orderBy(F.col("_day").desc()).rangeBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("_cum", F.last("_close", ignorenulls=True).over(earlier))
    paid = 1 - F.col("_dividend") / F.col("_cum")
    capital = F.col("_type").isin(*CAPITAL)
    both = both.withColumns(
        {
            "_capital": F.when(capital, F.col("_ratio")),
            "_total": F.when(capital, F.col("_ratio")).when(
                (F.col("_cum") > 0) & (F.col("_dividend") > 0) & (paid > 0), paid
            ),
        }
    )
    return both.withColumns(
        {
            "adj_factor": F.coalesce(F.product("_capital").over(later), F.lit(1.0)),
            "tr_factor": F.coalesce(F.product("_total").over(later), F.lit(1.0)),
        }
    )


def back_factors(raw: DataFrame, events: DataFrame) -> DataFrame:
    """Cumulative back-adjustment factors per (isin, date)."""
    out = factor_frame(raw.select("isin", "date", "close"), events)
    return out.filter(F.col("_type").isNull()).select("isin", "date", "adj_factor", "tr_factor")


def dividend_multipliers(raw: DataFrame, events: DataFrame) -> DataFrame:
    """Multiplier of each usable dividend."""
    out = factor_frame(raw.select("isin", "date", "close"), events.filter(F.col("type") == "dividend"))
    return out.filter(F.col("_type").isNotNull() & F.col("_total").isNotNull()).select(
        "isin",
        F.date_from_unix_date("_day").alias("ex_date"),
        F.col("_cum").alias("prior_close"),
        F.col("_total").alias("multiplier"),
    )


def adjust_prices(raw: DataFrame, events: DataFrame) -> DataFrame:
    """Split/bonus-adjusted OHLC, raw close, total-return close and the two factors."""
    out = factor_frame(raw, assign_events(raw, events)).filter(F.col("_type").isNull())
    adj = F.col("adj_factor")
    value = F.col("traded_value")
    usable = value.isNotNull() & ~F.isnan(value) & (value != 0)
    return out.select(
        "isin",
        "symbol",
        "date",
        *[(F.col(c) * adj).alias(c) for c in ("open", "high", "low")],
        (F.col("close") * adj).alias("close"),
        F.col("close").alias("close_raw"),
        (F.col("close") * F.col("tr_factor")).alias("close_tr"),
        "volume",
        F.when(usable, value).otherwise(F.col("close") * F.col("volume")).alias("traded_value"),
        "adj_factor",
        "tr_factor",
    )
