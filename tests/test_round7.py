"""Cases of the seventh round: ranks over ranked rows, the arithmetic of the SQL, work at size."""

from __future__ import annotations

import datetime as dt
import math
import random
from decimal import ROUND_HALF_UP, Decimal

import __spark_entry__ as contract
from barloom.operators import indicators, screens
from barloom.session import apply_settings
from barloom.sources import views

ROOT = "/root/testdata/sf0.001"


def test_ranks_against_the_index_replace_older_ones(spark):
    """Signals that were ranked before are ranked again, not joined to a second column of the name."""
    day = dt.date(2024, 1, 2)
    rows = [("D", k, day, float(10 - k), 7.0) for k in range(1, 5)]
    signals = spark.createDataFrame(rows, "timeframe string, symbol long, date date, momentum_12m double, rs_score double")
    index = spark.createDataFrame([(day, 100.0)], "date date, level double")
    got = {r["symbol"]: r["rs_score"] for r in indicators.rs_ranks_vs_index(signals, index).collect()}
    assert got == {1: 100.0, 2: 75.0, 3: 50.0, 4: 25.0}


def test_even_rsi_of_the_views_is_the_quotient_of_the_sql(spark):
    """Walks that are back at their start after 14 moves: the SQL's quotient is 50 or one last bit beside it."""
    draw, rows, want = random.Random(7), [], {}
    for symbol in range(400):
        walk = [round(draw.uniform(90, 110), 4) for _ in range(14)]
        walk.append(walk[0])
        moves = [b - a for a, b in zip(walk, walk[1:])]
        gain, loss = 0.0, 0.0
        for x in moves:
            gain, loss = gain + max(x, 0.0), loss + max(-x, 0.0)
        d = 1.0 - 1.0 / 14
        gain, loss = (x / 14 * math.pow(d, -14) * math.pow(d, 14) for x in (gain, loss))
        want[symbol] = 100.0 * gain / (gain + loss)
        rows += [(symbol, dt.date(2000, 1, 1 + k), close, close + 1, close - 1, close, 1.0) for k, close in enumerate(walk)]
    v = views.Views(apply_settings(spark), ROOT)
    v.bars = spark.createDataFrame(rows, "symbol long, date date, open double, high double, low double, close double, volume double")
    got = {r["symbol"]: r["rsi"] for r in v.panel.filter("timeframe = 'D' AND _bar = 14").select("symbol", "rsi").collect()}
    assert got == want
    assert 0 < sum(x != 50.0 for x in got.values()) < 200


def plan(spark, name):
    return contract.QUERIES[name](spark, ROOT)._jdf.queryExecution().executedPlan().toString()


def test_rounding_is_half_away_from_zero_without_decimal_texts(spark):
    """Halves, signs, large values, nulls and values that are no numbers; no text is made of a double."""
    values = [0.0, 1.5, -1.5, 2.5, 0.49, -0.49, 123456.5, -7.0, 9e15, -3e300, None, float("inf")]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(values)], "k int, x double")
    got = [r[0] for r in df.orderBy("k").select(views.whole(df["x"])).collect()]
    want = [x if x is None or abs(x) > 2**52 else float(Decimal(x).quantize(Decimal(1), ROUND_HALF_UP)) for x in values]
    assert got == want
    assert "round(" not in plan(spark, "w06_indicator_panel")


def test_panel_takes_fewer_passes(spark):
    """Long extremes by sixes on narrow rows, lags of the bars together."""
    assert plan(spark, "w06_indicator_panel").count("Window [") <= 20


def test_page_and_total_read_the_stored_newest_rows(spark):
    got = plan(spark, "t01_result_page_score")
    assert "Window [" not in got and "FileScan parquet [l_" not in got


def test_signals_of_a_screen_equal_those_of_its_members(spark):
    """One pass gives what the join of the signals with the screen's own rows gives."""
    v = views.Views(apply_settings(spark), ROOT)
    signals, stocks = v.scored.localCheckpoint(), v.stocks.filter("symbol % 3 <> 0")
    cols = ["date", "symbol", "entry_score"]
    want = screens.members_of_screen(signals, screens.materialise(signals, stocks, ["near_52w_high"]), "near_52w_high")
    got = screens.signals_of_screen(signals, stocks, "near_52w_high")
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))
    assert plan(spark, "j04_signals_in_screen").count("FileScan parquet [l_") == 1
