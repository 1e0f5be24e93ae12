"""Hand-checked cases of the main operators."""

import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import adjust, books, calendar, factors, fundamentals, identity, indicators, metrics, quality, regime, trades
from barloom.sources import storage

D = dt.date


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_resample_drops_the_open_week(spark):
    days = [D(2023, 1, 2) + dt.timedelta(days=i) for i in (0, 1, 2, 3, 4, 7, 8, 9)]
    rows = [(1, d, 10.0 + i, 12.0 + i, 9.0 + i, 11.0 + i, 1000.0) for i, d in enumerate(days)]
    bars = frame(spark, rows, "symbol long, date date, open double, high double, low double, close double, volume double")
    got = indicators.resample_bars(bars, "W-FRI").collect()
    assert len(got) == 1
    assert (got[0].date, got[0].open, got[0].high, got[0].low, got[0].close, got[0].volume) == (D(2023, 1, 6), 10.0, 16.0, 9.0, 15.0, 5000.0)


def test_rs_ranks(spark):
    rows = [("A", 20.0), ("B", 5.0), ("C", 15.0), ("D", None)]
    df = frame(spark, [(s, "D", D(2024, 1, 1), m) for s, m in rows], "symbol string, timeframe string, date date, momentum_12m double")
    got = {r.symbol: r.rs_score for r in indicators.rs_ranks(df).collect()}
    assert got["A"] == 100 and round(got["B"], 1) == 33.3 and round(got["C"], 1) == 66.7 and got["D"] is None


def test_internals_count_only_names_of_the_day_before(spark):
    d = [D(2024, 1, i) for i in (1, 2, 3)]
    rows = [("A", d[0], 10.0), ("A", d[1], 11.0), ("A", d[2], 12.0), ("B", d[0], 10.0), ("B", d[2], 9.0), ("C", d[1], 5.0), ("C", d[2], 5.0)]
    df = frame(spark, [(*r, 100.0) for r in rows], "isin string, date date, close double, adv_20 double")
    got = {r.date: r for r in regime.market_internals(df, 50.0).collect()}
    assert (got[d[0]].total, got[d[1]].total) == (0, 1) and got[d[0]].breadth_pct is None
    assert (got[d[2]].advancers, got[d[2]].unchanged, got[d[2]].total) == (1, 1, 2) and got[d[1]].ad_ratio == 1.0


def test_adjustment_factors(spark):
    days = [D(2024, 1, i) for i in (1, 2, 3, 4)]
    raw = frame(spark, [("I", "S", x, 100.0, 100.0, 100.0, 100.0, 10.0, 0.0) for x in days],
                "isin string, symbol string, date date, open double, high double, low double, close double, volume double, traded_value double")
    ev = frame(spark, [("I", "S", days[2], "split", 0.5, None), ("I", "S", days[3], "dividend", None, 10.0), ("I", "S", days[0], "dividend", None, 5.0)],
               "isin string, symbol string, ex_date date, type string, ratio double, dividend double")
    got = {r.date: r for r in adjust.adjust_prices(raw, ev).collect()}
    assert [got[x].adj_factor for x in days] == [0.5, 0.5, 1.0, 1.0]
    assert np.allclose([got[x].tr_factor for x in days], [0.45, 0.45, 0.9, 1.0])
    assert got[days[0]].traded_value == 1000.0 and got[days[0]].close == 50.0


def test_events_follow_the_symbol_to_a_new_id(spark):
    raw = frame(spark, [("OLD", "S", D(2024, 1, 1), 1.0), ("NEW", "S", D(2024, 2, 1), 1.0), ("NEW", "S", D(2024, 3, 1), 1.0)],
                "isin string, symbol string, date date, close double")
    ev = frame(spark, [("OLD", "S", D(2024, 2, 10), "split", 0.5, None), ("OLD", "S", D(2025, 2, 10), "split", 0.5, None)],
               "isin string, symbol string, ex_date date, type string, ratio double, dividend double")
    got = sorted((r.isin, r.ex_date) for r in adjust.assign_events(raw, ev).collect())
    assert got == [("NEW", D(2024, 2, 10)), ("OLD", D(2024, 2, 10)), ("OLD", D(2025, 2, 10))]


def test_chain_roots_of_long_chains_and_cycles(spark):
    edges = [(f"N{i}", f"N{i + 1}") for i in range(9)] + [("X", "Y")]
    got = {r.isin: r.root for r in identity.chain_roots(frame(spark, edges, "old_isin string, new_isin string")).collect()}
    assert got == {f"N{i}": "N0" for i in range(10)} | {"X": "X", "Y": "X"}
    with pytest.raises(ValueError):
        identity.chain_roots(frame(spark, [("P", "Q"), ("Q", "P")], "old_isin string, new_isin string"), max_rounds=4)


def test_succession_needs_two_signals_and_no_fork(spark):
    lives = frame(spark, [("INE000001010", "S", D(2024, 1, 1), D(2024, 1, 2)), ("INE000001020", "S", D(2024, 1, 3), D(2024, 1, 5)),
                          ("INE000009010", "T", D(2024, 1, 1), D(2024, 1, 1)), ("INE000008010", "T", D(2024, 1, 4), D(2024, 1, 5))],
                  "isin string, symbol string, first_date date, last_date date")
    cal = frame(spark, [(D(2024, 1, i),) for i in range(1, 6)], "date date")
    ev = frame(spark, [], "isin string, symbol string, ex_date date, type string, ratio double, dividend double")
    got = {r.symbol: r for r in identity.successor_map(lives, ev, cal).collect()}
    assert got["S"].asserted and got["S"].signals_matched == 2 and got["S"].root_isin == "INE000001010"
    assert not got["T"].asserted and got["T"].root_isin == ""
    forks = frame(spark, [("A", "B", True), ("A", "C", True), ("D", "E", True)], "old_isin string, new_isin string, asserted boolean")
    kept = {r.new_isin for r in identity.fork_guard(forks).filter("asserted").collect()}
    assert kept == {"E"}


def test_overlapping_legs_raise(spark):
    prices = frame(spark, [("A", D(2024, 1, 1)), ("B", D(2024, 1, 1))], "isin string, date date")
    pairs = frame(spark, [("A", "B", True, "A")], "old_isin string, new_isin string, asserted boolean, root_isin string")
    with pytest.raises(Exception, match="overlapping legs"):
        identity.collapse_identity(prices, pairs).collect()


def filings(spark, rows):
    return frame(spark, rows, "isin string, period_end date, available_date date, statement_type string, net_income double")


def test_as_of_lag_and_restatement(spark):
    p = D(2023, 12, 31)
    f = filings(spark, [("A", p, D(2024, 2, 1), "Quarterly", 1.0), ("A", p, D(2024, 3, 4), "Quarterly", 2.0)])
    days = frame(spark, [(D(2024, 2, 2),), (D(2024, 2, 5),), (D(2024, 2, 6),), (D(2024, 3, 5),), (D(2024, 3, 6),)], "date date")
    got = {r.as_of: r.net_income for r in fundamentals.as_of(f, days).collect()}
    assert got == {D(2024, 2, 5): 1.0, D(2024, 2, 6): 1.0, D(2024, 3, 5): 1.0, D(2024, 3, 6): 2.0}


def test_round_trips_and_holdings(spark):
    sides = ["buy", "sell", "buy", "buy", "trim", "buy"]
    rows = [("A", s, 1.0 * (i + 1), 10.0, D(2024, 1, i + 1), 0.5, i) for i, s in enumerate(sides)]
    fills = frame(spark, rows, "isin string, side string, qty double, price double, date date, cost double, fill_id int")
    got = sorted((r.entry_date.day, r.exit_date.day if r.exit_date else None) for r in trades.round_trips(fills).collect())
    assert got == [(1, 2), (4, 5), (6, None)]
    held = {r.date.day: (r.held_start, r.held_end) for r in trades.end_of_day_holdings(fills).collect()}
    assert held == {1: (0, 1), 2: (1, 0), 3: (0, 3), 4: (3, 7), 5: (7, 2), 6: (2, 8)}


def test_holdings_equal_a_walk_on_random_fills(spark):
    rnd = random.Random(11)
    rows = [(f"K{0 if i % 3 else rnd.randrange(4)}", rnd.choice(["buy", "trim", "trim", "sell"]), float(rnd.randrange(1, 9)), 1.0,
             D(2024, 1, 1) + dt.timedelta(days=rnd.randrange(25)), 0.0, i) for i in range(500)]
    fills = frame(spark, rows, "isin string, side string, qty double, price double, date date, cost double, fill_id int")
    got = {(r.isin, r.date): (r.held_start, r.held_end) for r in trades.end_of_day_holdings(fills).collect()}
    for name in {r[0] for r in rows}:
        h = 0.0
        mine = sorted((r for r in rows if r[0] == name), key=lambda r: (r[4], r[6]))
        for day, group in itertools.groupby(mine, key=lambda r: r[4]):
            start = h
            for r in group:
                h = 0.0 if r[1] == "sell" else h + r[2] if r[1] == "buy" else max(0.0, h - r[2])
            assert got[name, day] == pytest.approx((start, h))


def test_gini_equals_pairwise(spark):
    x = [3.0, -1.0, 4.0, 4.0, 10.0, 0.5]
    got = trades.gini(frame(spark, [(v,) for v in x], "pnl double"), "pnl").first().gini
    a = np.array(x)
    assert got == pytest.approx(np.abs(a[:, None] - a).sum() / len(a) ** 2 / (2 * a.mean()))


def test_relative_metrics_closed_forms(spark):
    rng = np.random.default_rng(1)
    r = rng.normal(0.0005, 0.01, 200)
    b, s, neg = (100 * np.cumprod(1 + k * r) for k in (1, 2, -1))
    days = [D(2023, 1, 1) + dt.timedelta(days=i) for i in range(200)]
    nav = frame(spark, [(d, float(x), float(y)) for d, x, y in zip(days, s, b)], "date date, equity double, benchmark double")
    assert metrics.relative_metrics(nav).first().beta == pytest.approx(2.0)
    nav = frame(spark, [(d, float(x), float(y)) for d, x, y in zip(days, neg, b)], "date date, equity double, benchmark double")
    assert metrics.relative_metrics(nav).first().correlation == pytest.approx(-1.0)


def test_overfit_probability_of_a_steady_winner_is_zero(spark):
    rows = [(cfg, fold, float(cfg) + 0.01 * fold) for cfg in range(4) for fold in range(4)]
    got = metrics.overfit_probability(frame(spark, rows, "config int, fold int, metric double"), tuple(range(4))).first()
    assert (got.pbo, got.splits) == (0.0, 6)


def test_fill_costs(spark):
    df = frame(spark, [("buy", 10.0, 100.0, 1e5), ("sell", 10.0, 100.0, 0.0)], "side string, qty double, price double, adv double")
    c = F.col
    got = [r.x for r in df.select(books.fill_cost(c("side"), c("qty"), c("price")).alias("x")).collect()]
    venue = 1000 * (0.0000297 + 0.000001) * 1.18
    assert got == pytest.approx([1.0 + venue + 0.15, 1.0 + venue + 15.34])
    px = [r.x for r in df.select(books.effective_price(c("side"), c("price"), c("qty"), c("adv")).alias("x")).collect()]
    assert px == pytest.approx([100 * (1 + 0.0015 + 0.15 * 0.01), 100 * (1 - 0.0015)])


def test_rescale_rejects_bad_factors(spark):
    df = frame(spark, [(100.0, 10.0, 0.0, 1.0)], "cost_basis double, shares double, f0 double, f1 double")
    with pytest.raises(Exception, match="factor must be positive"):
        df.select(*trades.rescale_position(F.col("f0"), F.col("f1"))).collect()


def test_weekday_lag_closed_form(spark):
    pairs = [(D(2024, 1, 1) + dt.timedelta(days=a), D(2024, 1, 1) + dt.timedelta(days=a + b)) for a in range(7) for b in range(20)]
    df = frame(spark, pairs, "a date, b date")
    for r in df.withColumn("n", calendar.weekday_lag(F.col("a"), F.col("b"))).collect():
        want = sum((r.a + dt.timedelta(days=k)).weekday() < 5 for k in range(1, (r.b - r.a).days + 1))
        assert r.n == want


def test_debounce_equals_state_machine(spark):
    rng = np.random.default_rng(4)
    level = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 400)))
    cfg = regime.RegimeConfig(dma_period=20, debounce_days=3)
    idx = frame(spark, [(D(2020, 1, 1) + dt.timedelta(days=i), float(x)) for i, x in enumerate(level)], "date date, level double")
    got = [r.fraction for r in regime.debounced_fraction(idx, cfg).orderBy("date").collect()]
    above = [True if i < 19 else level[i] > level[i - 19 : i + 1].mean() for i in range(400)]
    state, want = 1.0, []
    for i in range(400):
        last = above[max(0, i - 2) : i + 1]
        if len(last) == 3:
            state = 0.0 if state == 1.0 and not any(last) else 1.0 if state == 0.0 and all(last) else state
        want.append(state)
    assert got == want and len(set(want)) == 2


def test_gate_treats_missing_as_no(spark):
    df = frame(spark, [(10.0, 9.0, 100.0, 0.1), (10.0, None, 100.0, 0.1), (10.0, 9.0, 100.0, None)],
               "close double, ema200 double, adv_20 double, momentum_12_1 double")
    assert [r.g for r in df.select(factors.entry_gate(50.0).alias("g")).collect()] == [True, False, False]
    assert [r.g for r in df.select(factors.entry_gate(50.0, False).alias("g")).collect()] == [True, False, True]


def test_weights_must_be_complete_and_positive():
    assert factors.resolve_weights(["a", "b"], {"a": 1, "b": 3}) == {"a": 0.25, "b": 0.75}
    for bad in ({"a": 1}, {"a": 1, "b": -1}):
        with pytest.raises(ValueError):
            factors.resolve_weights(["a", "b"], bad)


def test_look_ahead_check_finds_a_leak(spark):
    from pyspark.sql import Window

    df = frame(spark, [("A", D(2024, 1, i), float(i)) for i in range(1, 11)], "isin string, date date, close double")
    w = Window.partitionBy("isin").orderBy("date")
    cut = F.lit("2024-01-05").cast("date")
    ok = quality.look_ahead(lambda p: p.withColumn("x", F.lag("close").over(w)), df, cut, ["close"])
    bad = quality.look_ahead(lambda p: p.withColumn("x", F.lead("close").over(w)), df, cut, ["close"])
    assert ok.count() == 0 and bad.count() == 2


def test_contract_and_idempotent_overwrite(spark, tmp_path):
    df = frame(spark, [("A", D(2024, 1, 1)), ("A", D(2025, 1, 1))], "isin string, date date")
    assert storage.conform(df.select("date", "isin"), storage.MEMBERSHIP, "m").columns == ["isin", "date"]
    for bad in (df.drop("date"), df.withColumn("x", F.lit(1))):
        with pytest.raises(storage.ContractError):
            storage.conform(bad, storage.MEMBERSHIP, "m")
    path = str(tmp_path / "t")
    for _ in range(2):
        storage.write_by_year(df, path)
    storage.write_by_year(df.filter("year(date) = 2024"), path)
    assert sorted(r.date.year for r in storage.read_membership(spark, path).collect()) == [2024, 2025]
    assert [r.date.year for r in storage.read_membership(spark, path, on="2024-01-01").collect()] == [2024]


def test_bar_files(spark, tmp_path):
    old = "SYMBOL,SERIES,OPEN,HIGH,LOW,CLOSE,LAST,PREVCLOSE,TOTTRDQTY,TOTTRDVAL,TIMESTAMP,TOTALTRADES,ISIN,\n"
    old += "AAA,EQ,1,2,0.5,1.5,1,1,100,150,02-JAN-2017,5,INE1,\nBBB,BE,1,2,1,1,1,1,1,1,02-JAN-2017,5,INE2,\nCCC,EQ,0,2,1,1,1,1,1,1,02-JAN-2017,5,INE3,\nDDD,EQ,1,2,1,1,1,1,1,1,03-JAN-17,5,INE4,\n"
    (tmp_path / "old.csv").write_text(old)
    got = sorted((r.isin, r.date, r.volume) for r in storage.read_bar_files(spark, str(tmp_path / "old.csv"), "legacy").collect())
    assert got == [("INE1", D(2017, 1, 2), 100), ("INE4", D(2017, 1, 3), 1)]
    new = "TradDt,FinInstrmTp,ISIN,TckrSymb,SctySrs,XpryDt,OpnPric,HghPric,LwPric,ClsPric,TtlTradgVol,TtlTrfVal,Extra\n"
    new += "2024-07-08,STK,INE1,AAA,EQ,,1,2,1,1.5,99.6,150,z\n2024-07-08,FUT,INE1,AAA,EQ,,1,2,1,1.5,9,1,z\n2024-07-08,STK,INE5,AAA,EQ,2024-08-01,1,2,1,1.5,9,1,z\n"
    (tmp_path / "new.csv").write_text(new)
    got = [(r.isin, r.date, r.volume, r.symbol) for r in storage.read_bar_files(spark, str(tmp_path / "new.csv"), "udiff").collect()]
    assert got == [("INE1", D(2024, 7, 8), 100, "AAA")]


def test_append_keeps_versions_and_correction_replaces_values(spark):
    cols = "isin string, period_end date, available_date date, x double"
    old = frame(spark, [("A", D(2023, 3, 31), D(2023, 5, 1), 1.0)], cols)
    new = frame(spark, [("A", D(2023, 3, 31), D(2023, 5, 1), 9.0), ("A", D(2023, 3, 31), D(2023, 6, 1), 2.0)], cols)
    keys = ["isin", "period_end", "available_date"]
    assert sorted(r.x for r in storage.append_new(old, new, keys).collect()) == [1.0, 2.0]
    assert sorted(r.x for r in storage.correct(old, new, keys, ["x"]).collect()) == [2.0, 9.0]
