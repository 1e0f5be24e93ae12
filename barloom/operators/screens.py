"""Named screens over the signals table.

Every function covers all dates at once; pass ``on_date`` to keep one day (the
predicate reaches the scan) or use :func:`latest` for the newest day.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from barloom.functions.asof import asof_join
from barloom.functions.windows import sure
from barloom.sources import storage

c = F.col


@dataclass(frozen=True)
class Screen:
    """A predicate on one signal row and the measure it is ranked by."""

    slug: str
    where: Callable[[], Column]
    score: str = "entry_score"
    ascending: bool = False


def _rsi(low: float | None, high: float, closed: bool = False) -> Column:
    top = c("rsi") <= high if closed else c("rsi") < high
    return top if low is None else (c("rsi") >= low) & top


SCREENS: dict[str, Screen] = {
    s.slug: s
    for s in (
        Screen(
            "actionable_entries",
            lambda: (c("ema_signal") == "bullish_cross")
            & c("above_200ema")
            & _rsi(35, 65, closed=True)
            & (c("momentum_12m") > 0)
            & c("is_consolidating")
            & (c("volume_breakout") | (c("adx") >= 25)),
        ),
        Screen(
            "momentum_monsters",
            lambda: (c("rs_score") >= 80)
            & (c("momentum_3m") >= 15)
            & (c("adx") >= 25)
            & c("above_200ema")
            & _rsi(None, 78),
            score="rs_score",
        ),
        Screen(
            "ema_crossover",
            lambda: (c("ema_signal") == "bullish_cross")
            & c("above_200ema")
            & (c("adx") >= 20)
            & _rsi(35, 70),
        ),
        Screen(
            "volume_surge",
            lambda: c("volume_breakout") & c("above_200ema") & c("is_bullish") & _rsi(35, 75),
        ),
        Screen(
            "rsi_recovery",
            lambda: c("rsi_signal").isin("bullish_recovery", "bullish_recovery_confirmed")
            & c("above_200ema")
            & _rsi(35, 60, closed=True)
            & (c("ema_slope_21") > 0),
        ),
        Screen(
            "near_52w_high",
            lambda: c("pct_from_52w_high").between(-5, 0)
            & c("above_200ema")
            & c("is_bullish")
            & _rsi(None, 78),
            score="pct_from_52w_high",
        ),
        Screen(
            "near_52w_low",
            lambda: c("pct_from_52w_low").between(0, 15)
            & _rsi(35, 55, closed=True)
            & (c("ema_slope_21") > 0),
            score="rsi",
            ascending=True,
        ),
        Screen(
            "near_breakout",
            lambda: c("pct_from_resistance").between(-3, 0.5)
            & c("above_200ema")
            & c("is_bullish")
            & _rsi(None, 75)
            & (c("volume_breakout") | (c("ema_slope_21") > 0)),
            score="pct_from_resistance",
        ),
        Screen(
            "fresh_52w_breakout",
            lambda: c("pct_from_52w_high").between(-1, 3)
            & c("volume_breakout")
            & c("above_200ema")
            & _rsi(50, 80)
            & (c("adx") >= 20),
        ),
    )
}


#: Columns of the signals that the screens read; stored signals need no others.
READ = (
    "timeframe symbol date ema_signal rsi_signal above_200ema is_bullish is_consolidating volume_breakout rsi adx entry_score"
    " rs_score momentum_3m momentum_12m ema_slope_21 pct_from_52w_high pct_from_52w_low pct_from_resistance"
).split()


def latest(signals: DataFrame, timeframe: str = "D") -> Column:
    """Newest date of a timeframe as a scalar subquery."""
    return signals.filter(c("timeframe") == timeframe).agg(F.max("date")).scalar()


def run_screen(slug: str, signals: DataFrame, stocks: DataFrame, timeframe: str = "D", on_date=None) -> DataFrame:
    """Rows of a screen with its score; inner to known stocks."""
    s = SCREENS[slug]
    df = signals.filter(c("timeframe") == timeframe)
    if on_date is not None:
        df = df.filter(c("date") == on_date)
    return (
        df.filter(s.where())
        .join(stocks.select("symbol"), "symbol", "left_semi")
        .select("date", "symbol", c(s.score).alias("score"))
    )


def growth_at_price(signals: DataFrame, stocks: DataFrame, ratios: DataFrame, timeframe: str = "D") -> DataFrame:
    """0 < PEG < 2 with rising price; ratios has (symbol, peg_ratio)."""
    hits = signals.filter(
        (c("timeframe") == timeframe)
        & c("above_200ema")
        & (c("rsi") < 75)
        & (c("momentum_1m") >= 5)
        & (c("ema_slope_21") > 0)
    )
    cheap = ratios.filter((c("peg_ratio") > 0) & (c("peg_ratio") < 2))
    return (
        hits.join(cheap, "symbol")
        .join(stocks.select("symbol"), "symbol", "left_semi")
        .select("date", "symbol", c("entry_score").alias("score"))
    )


def mtf_confluence(signals: DataFrame, stocks: DataFrame) -> DataFrame:
    """Daily, weekly and monthly bullish together.

    Weekly and monthly rows are those of the newest weekly/monthly date of the whole
    table at or before the day, not the newest per symbol.
    """
    tf = c("timeframe")

    def calendar(code: str, name: str) -> DataFrame:
        return signals.filter(tf == code).select(c("date").alias(name)).distinct()

    days = calendar("D", "date")
    days = asof_join(days, calendar("W", "w_date").withColumn("d", c("w_date")), [], "date", "d", ["w_date"], unique_left=True)
    months = calendar("M", "m_date").withColumn("d", c("m_date"))
    days = days.join(asof_join(days.select("date"), months, [], "date", "d", ["m_date"], unique_left=True), "date")

    def bullish(code: str, name: str) -> DataFrame:
        return signals.filter((tf == code) & c("is_bullish")).select("symbol", c("date").alias(name))

    daily = signals.filter(
        (tf == "D") & c("is_bullish") & c("above_200ema") & (c("rsi") >= 40) & (c("rsi") < 75)
    ).select("symbol", "date", "entry_score")
    return (
        daily.join(days, "date")
        .join(bullish("W", "w_date"), ["symbol", "w_date"], "left_semi")
        .join(bullish("M", "m_date"), ["symbol", "m_date"], "left_semi")
        .join(stocks.select("symbol"), "symbol", "left_semi")
        .select("date", "symbol", c("entry_score").alias("score"))
    )


def sector_leaders(signals: DataFrame, stocks: DataFrame, timeframe: str = "D", top: int = 3) -> DataFrame:
    hits = signals.filter(
        (c("timeframe") == timeframe) & c("above_200ema") & c("is_bullish") & c("rs_score").isNotNull()
    ).join(stocks.filter(c("sector").isNotNull()).select("symbol", "sector"), "symbol")
    place = F.rank().over(Window.partitionBy("date", "sector").orderBy(c("rs_score").desc()))
    return (
        hits.withColumn("sector_rank", place)
        .filter(c("sector_rank") <= top)
        .select("date", "sector", "symbol", "sector_rank", c("rs_score").alias("score"))
    )


def sector_rotation(signals: DataFrame, stocks: DataFrame, min_stocks: int = 3) -> DataFrame:
    """Sector averages per date, micro-sectors left out."""
    df = signals.filter((c("timeframe") == "D") & c("rs_score").isNotNull()).join(
        stocks.filter(c("sector").isNotNull()).select("symbol", "sector"), "symbol"
    )
    return (
        df.groupBy("date", "sector")
        .agg(
            F.avg("rs_score").alias("avg_rs"),
            F.avg("momentum_3m").alias("avg_momentum_3m"),
            (F.avg(c("is_bullish").cast("int")) * 100).alias("bullish_pct"),
            F.count("symbol").alias("stock_count"),
        )
        .filter(c("stock_count") >= min_stocks)
    )


def hot_sectors(signals: DataFrame, stocks: DataFrame, rotation: DataFrame, top: int = 3, min_rs: float = 60) -> DataFrame:
    """Bullish strong stocks of each date's leading sectors, by strength; the score is the entry score.

    Averages equal to nine digits tie, the name decides.
    """
    order = Window.partitionBy("date").orderBy(F.round("avg_rs", 9).desc(), "sector")
    lead = rotation.withColumn("_n", F.row_number().over(order)).filter(c("_n") <= top).select("date", "sector")
    return (
        signals.filter((c("timeframe") == "D") & (c("rs_score") >= min_rs) & c("above_200ema") & c("is_bullish"))
        .join(stocks.select("symbol", "sector"), "symbol")
        .join(lead, ["date", "sector"], "left_semi")
        .select("date", "sector", "symbol", "rs_score", c("entry_score").alias("score"))
    )


def materialise(signals: DataFrame, stocks: DataFrame, slugs: Sequence[str] = tuple(SCREENS)) -> DataFrame:
    """Every single-row screen (or those of ``slugs``) for every date, ranked, in one pass over the signals."""
    hits = F.array_compact(
        F.array(
            *[
                F.when(
                    sure(s.where()),
                    F.struct(
                        F.lit(s.slug).alias("screen_slug"),
                        c(s.score).alias("score"),
                        (c(s.score) if s.ascending else -c(s.score)).alias("_order"),
                    ),
                )
                for s in map(SCREENS.get, slugs)
            ]
        )
    )
    rows = (
        signals.filter(c("timeframe") == "D")
        .select("date", "symbol", F.explode(hits).alias("hit"))
        .join(stocks.select("symbol"), "symbol", "left_semi")
    )
    place = Window.partitionBy("hit.screen_slug", "date").orderBy("hit._order", "symbol")
    return rows.select(
        c("hit.screen_slug").alias("screen_slug"),
        c("date").alias("computed_at"),
        "symbol",
        c("hit.score").alias("score"),
        F.row_number().over(place).alias("rank"),
    )


def materialise_all(signals: DataFrame, stocks: DataFrame, rotation: DataFrame | None = None) -> DataFrame:
    """All twelve screens for every date: the single-row ones, and those that look at other rows.

    Confluence is ranked by entry score, sector leaders by sector and strength, hot sectors by strength;
    the symbol settles ties.
    """
    rotation = rotation if rotation is not None else sector_rotation(signals, stocks)
    out = materialise(signals, stocks)

    def ranked(slug: str, rows: DataFrame, *order: Column) -> DataFrame:
        place = Window.partitionBy("date").orderBy(*order, "symbol")
        return rows.select(F.lit(slug).alias("screen_slug"), c("date").alias("computed_at"), "symbol", "score", F.row_number().over(place).alias("rank"))

    both = ranked("mtf_confluence", mtf_confluence(signals, stocks), c("score").desc())
    leaders = ranked("sector_leaders", sector_leaders(signals, stocks), c("sector"), c("score").desc())
    hot = ranked("hot_sectors", hot_sectors(signals, stocks, rotation), c("rs_score").desc())
    return out.unionByName(both).unionByName(leaders).unionByName(hot)


RESULT = "screen_slug string, computed_at date, symbol long, score double, rank int, month string"


def store_results(results: DataFrame, days: DataFrame, path: str) -> None:
    """Replace the stored results of ``days`` (computed_at) by ``results``, one partition overwrite for all.

    The table is partitioned by month; the other days of a touched month are written again as they were.
    Every touched month gets one row without a screen, so days on which nothing passes any more are
    emptied too.  The overwrite takes effect when the job commits: a run that fails leaves the old days.
    """
    spark = results.sparkSession
    month = F.date_format("computed_at", "yyyy-MM").alias("month")
    days = F.broadcast(days.select("computed_at").distinct())  # one row a day
    names = ["screen_slug", "computed_at", "symbol", "score", "rank"]
    months = days.select(month).distinct()
    stored = read_results(spark, path).join(F.broadcast(months), "month", "left_semi")
    others = stored.join(days, "computed_at", "left_anti").select(*names, "month")
    new = results.join(days, "computed_at", "left_semi").select(*names, month)
    blank = months.select(*[F.lit(None).cast(t).alias(n) for n, t in (x.split() for x in RESULT.split(", ")[:-1])], "month")
    rows = new.unionByName(others).unionByName(blank).repartition("month")
    storage.write_partitions(storage.cut_lineage(rows), path, ["month"])


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return storage.read_or_empty(spark, path, StructType.fromDDL(RESULT)).filter(c("screen_slug").isNotNull())


def stored_results(spark: SparkSession, path: str) -> DataFrame:
    return read_results(spark, path).drop("month")


def enrich(results: DataFrame, signals: DataFrame, stocks: DataFrame, ratios: DataFrame) -> DataFrame:
    """Screen rows with stock, ratios and the newest daily signal of each symbol."""
    newest = (
        signals.filter(c("timeframe") == "D")
        .groupBy("symbol")
        .agg(F.max_by(F.struct(c("date").alias("signal_date"), "close", "rsi", "adx", "ema_signal", "is_bullish"), "date").alias("s"))
        .select("symbol", "s.*")
    )
    return (
        results.join(stocks, "symbol")
        .join(ratios, "symbol", "left")
        .join(newest, "symbol", "left")
    )


def members_of_screen(signals: DataFrame, results: DataFrame, slug: str) -> DataFrame:
    """Daily signals of names that are in a screen on the same date."""
    members = results.filter(c("screen_slug") == slug).select("symbol", c("computed_at").alias("date"))
    return signals.filter(c("timeframe") == "D").join(members, ["symbol", "date"], "left_semi")


def signals_of_screen(signals: DataFrame, stocks: DataFrame, slug: str) -> DataFrame:
    """As :func:`members_of_screen` over the screen's rows of these same signals.

    A symbol and a day name one daily signal, so the row that passes is the row to show: one pass and no join of
    the signals with themselves.
    """
    hits = signals.filter((c("timeframe") == "D") & sure(SCREENS[slug].where()))
    return hits.join(stocks.select("symbol"), "symbol", "left_semi")


def wide_net(signals: DataFrame) -> DataFrame:
    """First sieve: bullish or a score above 60."""
    return signals.filter((c("timeframe") == "D") & (c("is_bullish") | (c("entry_score") > 60)))


def liquidity_gate(stocks: DataFrame, bars: DataFrame, min_cap: float, min_value: float, days: int = 63) -> DataFrame:
    """Stocks large enough whose average volume times last price clears a floor."""
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(c("date").desc()))
    recent = (
        bars.withColumn("_n", back)
        .filter(c("_n") <= days)
        .groupBy("symbol")
        .agg(F.avg("volume").alias("avg_volume"), F.max_by("close", "date").alias("last_price"))
    )
    return stocks.filter(c("market_cap") > min_cap).join(recent, "symbol").filter(
        c("avg_volume") * c("last_price") > min_value
    )


def market_cap_bucket(cap: Column, large: float = 2e11, mid: float = 5e10) -> Column:
    return (
        F.when(cap.isNull() | (cap == 0), "unknown").when(cap >= large, "largecap").when(cap >= mid, "midcap").otherwise("smallcap")
    )


def search_stocks(stocks: DataFrame, text: str, limit: int = 15) -> DataFrame:
    """Case-insensitive search, best kind of match first, then the symbol."""
    code = c("symbol").cast("string")
    like = f"%{text}%"
    kind = (
        F.when(code == text.upper(), 0)
        .when(code.startswith(text.upper()), 1)
        .when(F.lower("name").startswith(text.lower()), 2)
        .otherwise(3)
    )
    return (
        stocks.filter(code.ilike(like) | c("name").ilike(like))
        .select("symbol", "name", "sector", kind.alias("kind"))
        .orderBy("kind", "symbol")
        .limit(limit)
    )


def list_stocks(stocks: DataFrame, sector: str | None = None, industry: str | None = None) -> DataFrame:
    df = stocks
    if sector is not None:
        df = df.filter(c("sector") == sector)
    if industry is not None:
        df = df.filter(c("industry") == industry)
    return df.orderBy("symbol")
