"""Filing states, day ranges, keyed streams, stored screens, retention and the filing index."""

import collections
import datetime as dt
import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from barloom.functions import scan
from barloom.operators import alerts, factors, fundamentals, metrics, screens, trades
from barloom.sources import storage
from barloom.streaming import jobs

D = dt.date


# --- filings ---

VERSION = "isin long, period_end date, available_date date, statement_type string, " + ", ".join(
    f"{x} double" for x in ("net_income", "cfo", "total_equity", "total_assets", "total_debt", "shares_outstanding", "debt_equity_ratio")
)


def random_versions(seed):
    """Restatements, periods that change their kind, gaps, late filings and missing items."""
    rng = random.Random(seed)
    out = []
    for isin in range(5):
        for q in range(14):
            if rng.random() < 0.15:
                continue
            end = D(2015 + q // 4, 3 * (q % 4) + 3, 28)
            for _ in range(rng.randint(1, 3)):
                kind = "Annual" if q % 4 == 3 and rng.random() < 0.7 or rng.random() < 0.05 else "Quarterly"
                items = [None if rng.random() < 0.2 else float(rng.randint(1, 90)) for _ in range(7)]
                out.append((isin, end, end + dt.timedelta(days=rng.randint(5, 400)), kind, *items))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_filing_states_equal_versions_seen_on_each_day(spark, seed):
    versions = spark.createDataFrame(random_versions(seed), VERSION)
    days = spark.createDataFrame([(D(2015, 1, 5) + dt.timedelta(days=7 * i),) for i in range(300)], "date date")
    want = fundamentals.item_state(fundamentals.as_of(versions, days))
    got = fundamentals.states_on_days(fundamentals.filing_states(versions), days)
    key = lambda df: {(r.as_of, r.isin): tuple(r[x] for x in fundamentals.STATE) for r in df.collect()}
    want, got = key(want), key(got)
    assert got.keys() == want.keys() and len(got) > 800
    for k in want:
        assert got[k] == pytest.approx(want[k]), k


def test_factor_frame_pairs_no_versions_with_days(spark):
    versions = spark.createDataFrame(random_versions(3), VERSION)
    days = spark.createDataFrame([(D(2017, 1, 31),), (D(2018, 1, 31),)], "date date")
    prices = spark.createDataFrame([(i, d, 10.0) for i in range(7) for d in (D(2017, 1, 31), D(2018, 1, 31))], "isin long, date date, close_raw double")
    frame = fundamentals.factor_frame(versions, prices, days)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
    assert frame.count() == 14
    assert fundamentals.filing_states(versions.filter("false")).count() == 0


# --- days of one hot name ---


def fills_of_a_hot_day(n=400, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        hot = i % 2 == 0
        day = D(2024, 1, 3) if hot else D(2024, 1, 1) + dt.timedelta(days=rng.randrange(6))
        rows.append(("A" if hot else rng.choice("ABC"), rng.choice(["buy", "buy", "trim", "sell"]), float(rng.randint(1, 9)), 2.0, day, 0.1, rng.randrange(1 << 59)))
    return rows


FILL = "isin string, side string, qty double, price double, date date, cost double, fill_id long"


def test_half_of_all_fills_on_one_day_are_scanned_in_ranges(spark):
    rows = fills_of_a_hot_day()
    fills = spark.createDataFrame(rows, FILL)
    order = ["fill_id", "side", "qty", "price"]
    ranges = scan.day_ranges(fills, ["isin"], "date", "fill_id", rows=20).filter("isin = 'A' AND date = '2024-01-03'").groupBy("_r").count().collect()
    assert len(ranges) >= 8 and max(r["count"] for r in ranges) < 60
    by_name = {}
    for r in sorted(rows, key=lambda r: (r[4], r[6])):
        by_name.setdefault(r[0], []).append(r)
    numbers = {(r.isin, r.fill_id): r.n for r in scan.number_rows(fills, ["isin"], "date", order, "n", rows=20).collect()}
    nexts = {(r.isin, r.fill_id): r.nx.fill_id if r.nx else None for r in scan.next_row(fills, ["isin"], "date", order, ["cost"], "nx", rows=20).collect()}
    held = {(r.isin, r.date): (r.held_start, r.held_end) for r in trades.end_of_day_holdings(fills, rows=20).collect()}
    for name, own in by_name.items():
        h, day = 0.0, None
        want = {}
        for i, r in enumerate(own):
            assert numbers[name, r[6]] == i + 1
            assert nexts[name, r[6]] == (own[i + 1][6] if i + 1 < len(own) else None)
            if r[4] != day:
                day = r[4]
                want[name, day] = [h, h]
            h = h + r[2] if r[1] == "buy" else max(h - r[2], 0.0) if r[1] == "trim" else 0.0
            want[name, day][1] = h
        for k, v in want.items():
            assert held[k] == pytest.approx(tuple(v)), k


# --- degenerate input ---


def test_ratios_of_empty_and_flat_runs_are_null(spark):
    none = spark.createDataFrame([], "isin string, entry_date date")
    assert trades.matched_pairs(none, none).first()["fraction"] is None
    assert trades.churn(spark.createDataFrame([(0.0, 0.0, 0.0)], "entry double, exit double, total double"), 2.0).first()[0] is None
    win = spark.createDataFrame([("A", D(2024, 1, 1), D(2024, 1, 5), 10.0, 20.0, 0.0, 4, "x"), ("B", D(2024, 1, 1), D(2024, 1, 5), 10.0, 10.0, 0.0, 4, "x")],
                                "isin string, entry_date date, exit_date date, buy_notional double, sell_notional double, cost double, hold_days int, exit_reason string")
    assert {r.payoff for r in trades.trip_forensic(win).collect()} == {None}
    flat = spark.createDataFrame([(D(2024, 1, i), 100.0 + i, 50.0) for i in range(1, 9)], "date date, equity double, benchmark double")
    assert metrics.relative_metrics(flat).count() == 1


# --- streams ---


def stream_of(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_watch_entries_expire_after_distinct_later_sessions(spark, tmp_path):
    day = lambda i: D(2024, 1, 1) + dt.timedelta(days=i)
    sessions = [(1, day(i)) for i in (9, 3, 4, 4, 5, 6, 7, 8, 8, 2, 1)] + [(2, day(i)) for i in range(9)] + [(3, day(i)) for i in range(1, 12)]
    entries = [(1, 10, day(0)), (1, 11, day(1)), (2, 20, day(0)), (3, 30, day(0)), (3, 31, day(2)), (3, 32, day(30))]
    kinds = "symbol long, date date"
    a = stream_of(spark, str(tmp_path / "s"), sessions[:15], kinds)
    stream_of(spark, str(tmp_path / "s"), sessions[15:], kinds)  # a second file, a later batch
    b = stream_of(spark, str(tmp_path / "e"), entries, "symbol long, entry_id long, signal_date date")
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    with jobs.keyed_state(spark):
        got = jobs.drain(jobs.expired_watches(b, a), str(tmp_path / "c"))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == provider
    rows = sorted((r.symbol, r.entry_id) for r in got.collect())
    want = jobs.expired_watches_batch(spark.createDataFrame(entries, "symbol long, entry_id long, signal_date date"), spark.createDataFrame(sessions, kinds))
    assert rows == [(1, 10), (3, 30), (3, 31)] == sorted((r.symbol, r.entry_id) for r in want.collect())
    left = spark.read.format("statestore").option("stateVarName", "entries").load(str(tmp_path / "c" / "state"))
    assert left.count() == 3  # 11, 20 and 32 still wait; the expired are gone


def test_a_source_that_stops_raises_its_flag(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", t0), ("a", t0 + dt.timedelta(hours=2)), ("b", t0 + dt.timedelta(hours=1))]
    stream = stream_of(spark, str(tmp_path / "in"), rows, "alert_type string, ts timestamp")
    with jobs.keyed_state(spark):
        got = jobs.watch_until_quiet(jobs.stale_sources(stream, "alert_type", 700), str(tmp_path / "c"), 0.3, 90)
    flagged = {(r.source, r.last_ts) for r in got.filter("stale").collect()}
    assert flagged == {("a", t0 + dt.timedelta(hours=2)), ("b", t0 + dt.timedelta(hours=1))}


def test_exit_alerts_once_over_batches_and_restarts(spark, tmp_path):
    t = lambda d, h: dt.datetime(2024, 1, d, h)
    kinds = "kind string, symbol long, position_id long, ts timestamp, entry_price double, stop_loss double, target double, low double, high double, close double, rsi double, prev_low double"
    blank = (None,) * 5
    first = [
        ("open", 1, 10, t(1, 0), 100.0, 90.0, 120.0, *blank), ("open", 1, 11, t(1, 0), 100.0, 95.0, 110.0, *blank), ("open", 2, 20, t(1, 0), 50.0, 40.0, 90.0, *blank),
        ("price", 1, None, t(1, 9), None, None, None, 94.0, 97.0, 96.0, 50.0, 93.0),  # 11: stop hit, 10: neither
        ("price", 1, None, t(1, 10), None, None, None, 94.0, 97.0, 96.0, 50.0, 93.0),  # the same again
        ("close", 1, 11, t(1, 12), None, None, None, *blank),
        ("price", 1, None, t(1, 13), None, None, None, 94.0, 111.0, 105.0, 85.0, 106.0),  # 11 is closed; 10: overextended
        ("price", 2, None, t(1, 13), None, None, None, 60.0, 60.0, 60.0, None, None),
    ]
    second = [("price", 1, None, t(2, 9), None, None, None, 89.0, 91.0, 90.5, 50.0, 80.0), ("price", 2, None, t(2, 9), None, None, None, 89.5, 89.5, 89.5, None, None)]
    path, log, state = str(tmp_path / "in"), str(tmp_path / "log"), str(tmp_path / "state")

    def run():
        events = spark.readStream.schema(kinds).parquet(path)
        part = [events.filter(F.col("kind") == k) for k in ("price", "open", "close")]
        with jobs.keyed_state(spark):
            jobs.exit_alerts(jobs.moves(*part, lanes=3)).writeStream.foreachBatch(jobs.logged_once(log)).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.symbol, str(r.date), r.alert_type, r.position_id) for r in spark.read.parquet(log).collect())

    stream_of(spark, path, first, kinds)
    day1 = [(1, "2024-01-01", "overextended_exit", 10), (1, "2024-01-01", "stop_hit", 11)]
    assert run() == day1
    assert run() == day1  # a restart without new rows
    stream_of(spark, path, second, kinds)
    assert run() == day1 + [(1, "2024-01-02", "stop_hit", 10), (2, "2024-01-02", "target_approached", 20)]
    jobs.logged_once(log)(spark.read.parquet(log).drop("day"), 9)  # a batch replayed
    assert spark.read.parquet(log).count() == 4


def test_unsent_exit_alerts(spark):
    rows = [(1, 7, D(2024, 1, 1), "stop_hit"), (1, 5, D(2024, 1, 1), "stop_hit"), (1, 5, D(2024, 1, 1), "target_hit"), (2, 9, D(2024, 1, 1), "stop_hit")]
    hits = spark.createDataFrame(rows, "symbol long, trade_id long, date date, alert_type string")
    log = spark.createDataFrame([(2, D(2024, 1, 1), "stop_hit"), (1, D(2024, 1, 2), "stop_hit")], "symbol long, date date, alert_type string")
    got = sorted((r.symbol, r.trade_id, r.alert_type) for r in alerts.unsent(hits, log).collect())
    assert got == [(1, 5, "stop_hit"), (1, 5, "target_hit")]


# --- universe ---


def test_review_medians(spark):
    rng = random.Random(8)
    rows = [(n, D(2020, 1, 1) + dt.timedelta(days=i), None if rng.random() < 0.01 else float(rng.randint(1, 99))) for n in range(4) for i in range(n, 60)]
    prices = spark.createDataFrame(rows, "isin long, date date, adv_20 double")
    days = [D(2020, 1, 1) + dt.timedelta(days=i) for i in (5, 20, 31, 59)]
    got = {(r.isin, r.date): r.liq for r in factors.review_medians(prices, spark.createDataFrame([(d,) for d in days], "date date"), 10).collect()}
    want = {}
    for n in range(4):
        own = [r for r in rows if r[0] == n]
        for d in days:
            last = [v for _, x, v in own if x <= d][-10:]
            if len(last) == 10 and None not in last and any(r[1] == d for r in own):
                v = sorted(last)
                want[n, d] = (v[4] + v[5]) / 2
    assert got == pytest.approx(want) and got


# --- sinks ---


def test_stored_screens_are_replaced_by_day(spark, tmp_path):
    path = str(tmp_path / "screens")
    d1, d2 = D(2024, 1, 1), D(2024, 1, 2)
    kinds = "screen_slug string, computed_at date, symbol long, score double, rank int"
    days = lambda *ds: spark.createDataFrame([(d,) for d in ds], "computed_at date")
    read = lambda: sorted((r.screen_slug, str(r.computed_at), r.symbol) for r in screens.stored_results(spark, path).collect())
    assert read() == []
    first = spark.createDataFrame([("a", d1, 1, 1.0, 1), ("b", d1, 2, 1.0, 1), ("a", d2, 3, 1.0, 1)], kinds)
    for _ in range(2):
        screens.store_results(first, days(d1, d2), path)
    assert read() == [("a", "2024-01-01", 1), ("a", "2024-01-02", 3), ("b", "2024-01-01", 2)]
    screens.store_results(first.filter("symbol = 2"), days(d1), path)  # "a" has no hits any more
    assert read() == [("a", "2024-01-02", 3), ("b", "2024-01-01", 2)]
    broken = first.withColumn("symbol", F.when(F.col("symbol") == 3, F.raise_error("lost").cast("long")).otherwise(F.col("symbol")))
    with pytest.raises(Exception, match="lost"):
        screens.store_results(broken, days(d1, d2), path)
    assert read() == [("a", "2024-01-02", 3), ("b", "2024-01-01", 2)]
    screens.store_results(first.filter("false"), days(d2), path)
    assert read() == [("b", "2024-01-01", 2)]


def test_filing_index_merges_by_key(spark, tmp_path):
    index, errors = str(tmp_path / "index"), str(tmp_path / "errors")
    kinds = "isin string, period_end date, available_date date, statement_type string, url string"
    rows = [
        ("A", D(2020, 3, 31), D(2020, 5, 1), "Quarterly", "u1"), ("A", D(2020, 3, 31), D(2020, 5, 1), "Quarterly", "u0"),
        ("A", D(2020, 3, 31), D(2020, 6, 1), "Quarterly", "u2"), ("A", D(2020, 3, 31), D(2020, 5, 1), "Annual", "u3"),
        ("B", D(2021, 3, 31), D(2021, 3, 31), "Quarterly", "bad"), ("B", D(2021, 6, 30), None, "Quarterly", "bad"), ("B", D(2021, 3, 31), D(2021, 4, 1), "Quarterly", "u4"),
    ]
    df = spark.createDataFrame(rows, kinds)
    assert tuple(storage.populate_filing_index(df, index, errors, "r1").first()) == (4, 0, 2)
    of_2020 = lambda: {f for f in spark.read.parquet(index).inputFiles() if "year=2020" in f}
    files = of_2020()
    later = spark.createDataFrame([*rows, ("C", D(2021, 12, 31), D(2022, 2, 1), "Annual", "u5")], kinds)
    assert tuple(storage.populate_filing_index(later, index, errors, "r2").first()) == (1, 4, 2)
    assert tuple(storage.populate_filing_index(later, index, errors, "r2").first()) == (0, 5, 2)
    stored = spark.read.parquet(index)
    assert sorted(r.url for r in stored.collect()) == ["u0", "u2", "u3", "u4", "u5"]
    assert of_2020() == files != set()  # the untouched year keeps its files
    assert spark.read.parquet(errors).groupBy("run_id").count().count() == 2 and spark.read.parquet(errors).count() == 4
    assert tuple(storage.populate_filing_index(df.filter("false"), index, errors, "r3").first()) == (0, 0, 0)


def test_clean_up_touches_only_old_partitions(spark, tmp_path):
    path = str(tmp_path / "signals")
    today = D(2024, 6, 30)
    rows = [(tf, s, today - dt.timedelta(days=n)) for tf in "DW" for s in (1, 2) for n in (0, 90, 91, 200, 365, 730, 731, 1100)]
    df = spark.createDataFrame(rows, "timeframe string, symbol long, date date").withColumn("year", F.year("date"))
    storage.write_partitions(df.coalesce(1), path, ["timeframe", "year"])
    young = lambda: {f for f in spark.read.parquet(path).inputFiles() if "timeframe=W" in f and "year=2022" not in f and "year=2021" not in f}
    files = young()
    table = {"signals": storage.Retention(path, 30, {"D": 90, "W": 730}), "none": storage.Retention(str(tmp_path / "absent"), 30)}
    assert storage.clean_up(spark, table, today) == {"signals_D": 12, "signals_W": 4}
    assert storage.clean_up(spark, table, today) == {"signals_D": 0, "signals_W": 0}
    left = spark.read.parquet(path)
    assert sorted((r.timeframe, (today - r.date).days) for r in left.filter("symbol = 1").collect()) == [("D", 0), ("D", 90), ("W", 0), ("W", 90), ("W", 91), ("W", 200), ("W", 365), ("W", 730)]
    assert young() == files != set()


@pytest.mark.parametrize(
    "passed, gaps, band, stops, verdict",
    [
        ([True] * 6, 0, True, 0, "GRADUATED"), ([False] + [True] * 7, 0, True, 0, "CLOCK RESET"), ([True] * 6 + [False], 0, True, 0, "AT RISK"),
        ([True] * 7, 1, True, 0, "AT RISK"), ([True] * 7, 0, False, 0, "AT RISK"), ([True] * 7, 0, None, 0, "ON TRACK"), ([True] * 7, 0, True, 5, "HALT"),
        ([True] * 3, 0, True, 0, "ON TRACK"),
    ],
)
def test_scorecard_verdicts(spark, passed, gaps, band, stops, verdict):
    from barloom.operators import books

    month = lambda i: D(2024, 1 + i, 28)
    clock = books.clean_clock(spark.createDataFrame([(month(i), p) for i, p in enumerate(passed)], "date date, passed boolean"))
    missing = spark.createDataFrame([(month(i),) for i in range(gaps)], "date date")
    ledger = spark.createDataFrame([(band,)] if band is not None else [], "within_band boolean")
    stopped = spark.createDataFrame([(month(0), stops)], "decision_date date, stops long")
    nav = spark.createDataFrame([(D(2024, 1, 1), 100.0, 100.0), (D(2024, 2, 1), 80.0, 120.0)], "date date, equity double, benchmark double")
    row = books.scorecard(clock, missing, ledger, stopped, spark.createDataFrame([(0.1,)], "max_drawdown double"), nav).first()
    assert row.verdict == verdict and row.directional == "insufficient_data"


def test_overfit_probability_has_no_cap_on_folds(spark):
    rows = [(cfg, fold, float(cfg) + 0.001 * fold) for cfg in range(3) for fold in range(17)]
    got = metrics.overfit_probability(spark.createDataFrame(rows, "config int, fold int, metric double"), tuple(range(17))).first()
    assert (got.pbo, got.splits) == (0.0, 24310)  # 17 over 8
    rng = random.Random(2)
    rows = [(cfg, fold, rng.random()) for cfg in range(5) for fold in range(6)]
    got = metrics.overfit_probability(spark.createDataFrame(rows, "config int, fold int, metric double"), tuple(range(6))).first()
    value, low = {(a, b): m for a, b, m in rows}, 0
    for inside in itertools.combinations(range(6), 3):
        mean = lambda cfg, part: sum(value[cfg, f] for f in part) / 3
        outside = [f for f in range(6) if f not in inside]
        best = max(range(5), key=lambda cfg: mean(cfg, inside))
        low += sum(mean(cfg, outside) < mean(best, outside) for cfg in range(5)) / 5 < 0.5
    assert (got.pbo, got.splits) == (low / 20, 20)


def test_samples_are_distinct_and_even(spark):
    n, k, draws = 7, 3, 3000
    picks = spark.range(draws).select("id", metrics.floyd_sample(F.lit(n), k, F.lit(1), F.col("id")).alias("s")).collect()
    assert all(len(set(r.s)) == k and set(r.s) <= set(range(1, n + 1)) for r in picks)
    seen = collections.Counter(x for r in picks for x in r.s)
    assert all(abs(seen[x] / draws - k / n) < 0.04 for x in range(1, n + 1))
    few = spark.range(1).select(metrics.floyd_sample(F.lit(2), 5, F.lit(1)).alias("a"), metrics.floyd_sample(F.lit(0), 5, F.lit(1)).alias("b")).first()
    assert sorted(few.a) == [1, 2] and few.b == []


def test_subset_retention_makes_draws_times_drop_rows(spark):
    names = spark.createDataFrame([(f"n{i}", float(i + 1)) for i in range(40)], "isin string, pnl double")
    numbers = {r.k: r.isin for r in metrics.numbered(names, "isin", "k").collect()}
    assert sorted(numbers) == list(range(1, 41)) and len(set(numbers.values())) == 40
    assert [numbers[k] for k in range(1, 41)] == sorted(numbers.values(), key=lambda x: (hashlib.md5(x.encode()).hexdigest(), x))
    all_gone = metrics.subset_retention(names, 20, 40, 1).first()
    assert (all_gone.draws, all_gone.median, all_gone.p5) == (20, 0.0, 0.0)
    some = metrics.subset_retention(names, 200, 4, 1).first()
    assert some.draws == 200 and 0.8 < some.p5 < some.median < 1.0
    assert metrics.subset_retention(names.limit(0), 5, 3, 1).first().draws == 0
    plan = metrics.subset_retention(names, 20, 4, 1)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
