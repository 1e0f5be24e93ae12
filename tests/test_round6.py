"""Cases of the sixth round: queries do no work that their result does not need."""

from __future__ import annotations

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from barloom.operators import alerts, screens
from barloom.operators.indicators import SignalConfig
from barloom.session import apply_settings
from barloom.sources import storage, views

ROOT = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def plan(spark, name):
    return plan_of(contract.QUERIES[name](spark, ROOT))


def test_candidates_leave_slower_bars_and_ranks_out(spark):
    """Weekly and monthly bars are gone before any window, and no day is ranked for a score nobody reads."""
    for name in ("p16_entry_candidates", "p16_near_high_candidates"):
        got = plan(spark, name)
        assert "Union" not in got and "Join" not in got


def test_alerts_of_several_configs_read_the_lines_once(spark):
    """One pass gives what one pass for each config gave."""
    assert plan(spark, "t06_best_alert_per_symbol").count("FileScan parquet [l_") == 1


def test_one_pass_equals_one_call_for_each_config(spark):
    draw = random.Random(6)
    cols = "symbol long, date date, timeframe string, ema_signal string, above_200ema boolean, rsi double, momentum_12m double, entry_score double, volume_breakout boolean, adx double, is_consolidating boolean, close double, ema21 double"
    rows = [
        (k % 9, dt.date(2024, 1, 1) + dt.timedelta(k), "D" if k % 7 else "W", draw.choice(["bullish_cross", "bullish"]), draw.choice([True, True, None]),
         draw.uniform(30, 70), draw.uniform(-1, 9), draw.uniform(20, 90), draw.choice([True, False, None]), draw.choice([None, 10.0, 25.0, 40.0]),
         draw.choice([True, False]), 100.0, 98.0)
        for k in range(600)
    ]
    signals = spark.createDataFrame(rows, cols)
    stocks = spark.createDataFrame([(k, f"n{k}", None if k == 3 else "s") for k in range(8)], "symbol long, name string, sector string")
    configs = {"loose": SignalConfig(score_threshold=30.0, require_consolidation=False), "tight": SignalConfig(min_signal_tier=1)}
    got = sorted(map(str, alerts.entry_alerts_of(signals, stocks, configs).collect()))
    one = [alerts.entry_alerts(signals, stocks, cfg).withColumn("strategy_id", F.lit(name)) for name, cfg in configs.items()]
    want = sorted(map(str, one[0].unionByName(one[1]).collect()))
    assert len({x.split("strategy_id=")[1] for x in want}) == 2 and got == want


def test_stored_signals_hold_what_screens_read(spark, monkeypatch):
    """The stored table has the columns of the screens, not the whole panel."""

    class Seen(Exception):
        pass

    def seen(df, path, by):
        raise Seen(sorted(df.columns))

    monkeypatch.setattr(storage, "write_partitions", seen)
    with pytest.raises(Seen) as got:
        contract.QUERIES["s16_materialised_screens"](spark, ROOT)
    assert got.value.args[0] == sorted(screens.READ) and len(screens.READ) < 20


@pytest.mark.parametrize("name", ["a03_confluence_count", "a04_daily_report", "j03_enriched_screen", "j04_signals_in_screen", "j06_timeframe_state", "p01_actionable_entries", "p17_dashboard_facets", "p23_signal_digest"])
def test_no_day_is_ranked_where_no_rank_is_read(spark, name):
    assert "ShuffledHashJoin" not in plan(spark, name)


def test_scan_tasks_do_not_keep_what_they_read(spark, monkeypatch):
    """Lines are dealt to no more tasks than Spark writes to without sorting a whole row group in memory."""
    monkeypatch.setattr(views, "LINES_PER_TASK", 20)
    v = views.Views(apply_settings(spark), ROOT)
    sizes = [int(n) for n in re.findall(r"Exchange hashpartitioning\(.*?, (\d+)\)", plan_of(v.bars))]
    assert sizes == [v.parts, 200] and v.parts > 200
