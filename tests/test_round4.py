"""Cases of the fourth round: the wide windows' tasks, lagged market dates, starts and counts."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.operators import dashboard
from barloom.session import apply_settings
from barloom.sources import views


@pytest.mark.parametrize("lines, parts", [(10_000, 1), (1_000, 6), (200, 30)])
def test_signal_tasks_grow_with_the_lines(spark, monkeypatch, lines, parts):
    monkeypatch.setattr(views, "LINES_PER_TASK", lines)
    v = views.Views(apply_settings(spark), "/root/testdata/sf0.001")
    assert v.parts == -(-v.table("lineitem").count() // lines) == parts
    plan = v.signals._jdf.queryExecution().executedPlan().toString()
    wide = [line for line in plan.splitlines() if "Exchange hashpartitioning(timeframe" in line]
    assert len(wide) <= 1  # the ranked columns alone are dealt by day
    used = v.signals.groupBy(F.spark_partition_id()).count().count()
    assert used > 1 or parts == 1


def test_changes_skip_a_symbol_that_missed_the_market_date_before(spark):
    day = lambda d: dt.date(2024, 1, d)
    row = lambda s, d, bull, tf="D": (tf, s, day(d), bull, float(d), 10.0, 0.0)
    rows = [row(1, 2, False), row(1, 3, True), row(1, 5, False),
            row(2, 2, False), row(2, 5, True),  # not there on the 3rd
            row(1, 4, True, "W"), row(2, 4, True, "W")]  # no market date between the 3rd and the 5th
    signals = spark.createDataFrame(rows, "timeframe string, symbol long, date date, is_bullish boolean, entry_score double, close double, price_change_pct double")
    got = sorted((r["symbol"], r["date"].day, r["prev_date"].day, r["change_type"], r["prev_score"]) for r in dashboard.signal_changes(signals).collect())
    assert got == [(1, 3, 2, "newly_bullish", 2.0), (1, 5, 3, "turned_bearish", 3.0)]
