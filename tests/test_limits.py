"""No caps, prefixes or divisions that change or fail a result at scale."""

import pytest
from pyspark.sql import functions as F

from barloom.functions import recur
from barloom.operators import dashboard, indicators, metrics
from barloom.sources import storage, views


def test_ids_keep_all_digits(spark):
    df = spark.createDataFrame([(7,), (100000,), (1000000,)], "symbol long")
    got = [r[0] for r in df.select(views.isin_code(F.col("symbol"), F.lit(1))).collect()]
    assert got == ["INE000007010", "INE100000010", "INE1000000010"]


def test_slow_average_of_a_constant_stays_constant(spark):
    df = spark.range(80_000).select(F.lit("a").alias("k"), F.col("id").alias("date"), F.lit(5.0).alias("x"))
    item = recur.ema_of("e", F.col("x"), 200)
    out = recur.solve(recur.number_bars(df, ["k"]), [item], ["k"])
    low, high, n = out.agg(F.min("e"), F.max("e"), F.count("e")).first()
    assert n == 80_000 and abs(low - 5) < 1e-9 and abs(high - 5) < 1e-9


def test_flat_instrument_does_not_fail_the_panel(spark):
    days = spark.range(40).select(F.date_add(F.lit("2024-01-01"), F.col("id").cast("int")).alias("date"))
    bars = days.select(F.lit(1).alias("symbol"), "date", *[F.lit(10.0).alias(c) for c in ("open", "high", "low", "close")], F.lit(1).cast("long").alias("volume"))
    panel = indicators.indicator_panel(indicators.stack_timeframes(bars))
    assert panel.where("timeframe = 'D'").count() == 40


def test_config_without_variance_has_no_ratio(spark):
    rows = [("flat", 0.01)] * 5 + [("live", x) for x in (0.01, -0.02, 0.03, 0.0)]
    got = {r["config"]: r["sharpe"] for r in metrics.deflated_sharpe(spark.createDataFrame(rows, "config string, ret double"), 3).collect()}
    assert got["flat"] is None and got["live"] is not None


def test_score_history_is_whole_or_newest(spark):
    df = spark.range(300).select(F.lit("a").alias("symbol"), F.date_add(F.lit("2024-01-01"), F.col("id").cast("int")).alias("date"), F.lit("D").alias("timeframe"), F.col("id").cast("double").alias("entry_score"))
    assert dashboard.score_history(df).count() == 300
    assert dashboard.score_history(df, 10).agg(F.min("entry_score")).first()[0] == 290


def test_shared_folder_must_be_named_off_a_local_master():
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError):
        storage.shared_dir(Session())
