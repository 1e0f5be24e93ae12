"""Cases of the fifth round: values that are read twice, exact ties, tasks at size."""

from __future__ import annotations

import datetime as dt
import random
import re
from itertools import combinations

from pyspark.sql import functions as F

from barloom.operators import indicators, metrics
from barloom.session import apply_settings
from barloom.sources import views


def test_overfit_probability_reads_each_average_once(spark):
    """Last bits that differ from one evaluation to the next do not put a winner below itself."""
    draw = random.Random(5)
    rows = [(k, f, draw.gauss(0, 1)) for k in range(12) for f in range(7)]
    noise = F.udf(lambda x: x * (1 + random.SystemRandom().uniform(-1, 1) * 1e-13), "double").asNondeterministic()
    matrix = spark.createDataFrame(rows, "config long, fold int, metric double").withColumn("metric", noise("metric"))
    below = []
    value = {(k, f): x for k, f, x in rows}
    for inside in combinations(range(7), 3):
        side = lambda k, take: sum(value[k, f] for f in range(7) if (f in inside) == take) / (3 if take else 4)  # noqa: B023, E731
        best = max(range(12), key=lambda k: side(k, True))
        below.append(sum(side(k, False) < side(best, False) for k in range(12)) / 12 < 0.5)
    for _ in range(3):
        got = metrics.overfit_probability(matrix, tuple(range(7))).first()
        assert got["splits"] == len(below)
        assert abs(got["pbo"] - sum(below) / len(below)) < 1e-12


def test_as_much_gain_as_loss_is_an_rsi_of_exactly_fifty(spark):
    """Walks that are back at their start after 14 moves: no month of them is above 50."""
    draw, rows = random.Random(7), []
    for symbol in range(400):
        walk = [round(draw.uniform(90, 110), 4) for _ in range(14)]
        walk += [walk[0]] * 2  # the 14th move leads back, the 15th is none
        for k, close in enumerate(walk):
            day = dt.date(2000 + k // 12, k % 12 + 1, 28)
            rows.append(("M", symbol, day, close, close + 1, close - 1, close, 1.0))
    bars = spark.createDataFrame(rows, "timeframe string, symbol long, date date, open double, high double, low double, close double, volume double")
    got = indicators.boolean_signals(indicators.indicator_panel(bars)).filter("_bar >= 14").select("rsi", "bullish_flag").collect()
    assert len(got) == 800
    assert {r["rsi"] for r in got} == {50.0}
    assert not any(r["bullish_flag"] for r in got)


def test_lines_are_dealt_before_they_are_added_up(spark, monkeypatch):
    """Every task of bars, panel and scores comes from the number that grows with the lines."""
    monkeypatch.setattr(views, "LINES_PER_TASK", 500)
    v = views.Views(apply_settings(spark), "/root/testdata/sf0.001")
    plan = v.signals._jdf.queryExecution().executedPlan().toString()
    sizes = [int(n) for n in re.findall(r"Exchange hashpartitioning\(.*?, (\d+)\)", plan)]
    assert len(sizes) >= 3 and set(sizes) == {v.parts}
    scans = plan[plan.rindex("Exchange hashpartitioning"):]  # the deepest exchange reads the file
    assert "FileScan" in scans and "Aggregate" not in scans


def test_shares_of_a_day_add_up(spark):
    """Lines of one symbol and day in all shares give one bar with their sums."""
    v = views.Views(apply_settings(spark), "/root/testdata/sf0.001")
    lines = v.table("lineitem").withColumns({"l_suppkey": F.lit(1).cast("long"), "l_shipdate": F.to_timestamp(F.concat(F.lit("1996-01-0"), F.col("l_linenumber")))})
    v.table = lambda name: lines
    got = sorted((r["date"].day, r["volume"]) for r in v.bars.collect())
    assert got == sorted((r["l_linenumber"], float(r["v"])) for r in lines.groupBy("l_linenumber").agg(F.sum("l_quantity").alias("v")).collect())
