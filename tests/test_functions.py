"""Window, as-of and scan helpers against plain sequential loops."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions import recur, scan, text
from barloom.functions.asof import asof_join
from barloom.functions.windows import (
    pct_rank_avg,
    rolling_median,
    with_frame_sums,
    with_rolling_extremes,
)

DAY0 = dt.date(2000, 1, 1)


def series(spark, n, seed=1, key="A"):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    rows = [(key, DAY0 + dt.timedelta(days=i), float(x)) for i, x in enumerate(close)]
    return spark.createDataFrame(rows, "k string, date date, close double"), close


@pytest.mark.parametrize("span", [2, 5, 13, 26, 50, 200])
def test_ema_equals_loop_over_block_borders(spark, span):
    df, close = series(spark, 2600)
    out = recur.solve(recur.number_bars(df, ["k"]), [recur.ema_of("e", F.col("close"), span)], ["k"])
    got = np.array([r.e for r in out.orderBy("date").collect()])
    want, a = [close[0]], 2 / (span + 1)
    for x in close[1:]:
        want.append(want[-1] + a * (x - want[-1]))
    assert np.allclose(got, want, rtol=1e-11)


@pytest.mark.parametrize("n", [14, 20])
def test_wilder_equals_loop(spark, n):
    from barloom.operators.factors import wilder_average

    df, close = series(spark, 2300, seed=3)
    got = [r.rma for r in wilder_average(df, F.col("close"), n, ["k"]).orderBy("date").collect()]
    assert got[: n - 1] == [None] * (n - 1)
    want = [close[:n].mean()]
    for x in close[n:]:
        want.append((want[-1] * (n - 1) + x) / n)
    assert np.allclose(got[n - 1 :], want, rtol=1e-10)


def test_rolling_extremes_and_sums(spark):
    df, x = series(spark, 700, seed=5)
    frames = {"hi": ("max", 252, 0), "lo": ("min", 252, 0), "res": ("max", 240, 20), "four": ("max", 4, 0)}
    out = with_rolling_extremes(df, "close", frames, ["k"])
    out = with_frame_sums(out, {"s": (F.col("close"), 50)}, ["k"]).orderBy("date").collect()
    for i, r in enumerate(out):
        assert r.hi == max(x[max(0, i - 251) : i + 1])
        assert r.lo == min(x[max(0, i - 251) : i + 1])
        assert r.four == max(x[max(0, i - 3) : i + 1])
        assert r.res == (max(x[max(0, i - 259) : i - 19]) if i >= 20 else None)
        assert r.s_n == min(i + 1, 50) and abs(r.s - sum(x[max(0, i - 49) : i + 1])) < 1e-8


def test_rolling_median_is_causal_and_exact(spark):
    df, x = series(spark, 60, seed=6)
    got = [r.m for r in df.withColumn("m", rolling_median(F.col("close"), 20, ["k"])).orderBy("date").collect()]
    assert np.allclose(got, [np.median(x[max(0, i - 19) : i + 1]) for i in range(60)])
    spiked = df.withColumn("close", F.when(F.col("date") > DAY0 + dt.timedelta(days=40), 1e9).otherwise(F.col("close")))
    again = [r.m for r in spiked.withColumn("m", rolling_median(F.col("close"), 20, ["k"])).orderBy("date").collect()]
    assert again[:41] == got[:41]


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("forward", [False, True])
def test_asof_equals_brute_force(spark, strict, forward):
    rnd = random.Random(7)
    left = [(rnd.randrange(3), rnd.randrange(60)) for _ in range(120)]
    right = sorted({(rnd.randrange(3), rnd.randrange(60)) for _ in range(40)})
    ld = spark.createDataFrame(left, "k int, t int")
    rd = spark.createDataFrame([(k, u, u * 10) for k, u in right], "k int, u int, v int")
    got = sorted((r.k, r.t, r.v) for r in asof_join(ld, rd, ["k"], "t", "u", ["v"], strict=strict, forward=forward).collect())

    def find(k, t):
        if forward:
            c = [u for kk, u in right if kk == k and (u > t if strict else u >= t)]
            return min(c) * 10 if c else None
        c = [u for kk, u in right if kk == k and (u < t if strict else u <= t)]
        return max(c) * 10 if c else None

    key = lambda r: (r[0], r[1], r[2] is None, r[2] or 0)
    assert sorted(got, key=key) == sorted([(k, t, find(k, t)) for k, t in left], key=key)


def test_percentile_rank_shares_ties(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 5.0), (1, 1.0), (1, None)], "d int, x double")
    got = sorted(r.p for r in df.withColumn("p", pct_rank_avg(F.col("x"), ["d"])).collect() if r.p is not None)
    assert np.allclose(got, [1 / 3, 2.5 / 3, 2.5 / 3])


def hot_rows(spark, n=900):
    """One key owns two thirds of the rows, most of them on few days and with equal values."""
    rnd = random.Random(3)
    rows = []
    for i in range(n):
        key = "hot" if i % 3 else f"k{rnd.randrange(20)}"
        rows.append((key, DAY0 + dt.timedelta(days=rnd.randrange(6)), i, rnd.choice([1.0, 1.0, 2.0, -3.0, rnd.random()])))
    return rows, spark.createDataFrame(rows, "k string, date date, i int, x double")


def test_row_numbers_and_next_row_with_a_hot_key(spark):
    rows, df = hot_rows(spark)
    got = {(r.k, r.i): r.n for r in scan.number_rows(df, ["k"], "date", ["i"], "n").collect()}
    nxt = {(r.k, r.i): (r.nx.i if r.nx else None) for r in scan.next_row(df, ["k"], "date", ["i"], ["x"], "nx").collect()}
    by = {}
    for k, d, i, _ in rows:
        by.setdefault(k, []).append((d, i))
    for k, items in by.items():
        items.sort()
        for pos, (_, i) in enumerate(items):
            assert got[k, i] == pos + 1
            assert nxt[k, i] == (items[pos + 1][1] if pos + 1 < len(items) else None)


def test_prefix_sums_and_quantiles_with_a_hot_value(spark):
    rows, df = hot_rows(spark)
    q = scan.quantiles(df, "x", {"p25": 0.25, "p50": 0.5, "p95": 0.95}).first()
    values = np.array([r[3] for r in rows])
    assert np.allclose([q.p25, q.p50, q.p95], np.quantile(values, [0.25, 0.5, 0.95]))
    for r in scan.quantiles(df, "x", {"m": 0.5}, ["k"]).collect():
        assert abs(r.m - np.median([x[3] for x in rows if x[0] == r.k])) < 1e-12


def one(spark, value, *cols):
    df = spark.createDataFrame([(value,)], "s string")
    return df.select(*cols).first()


@pytest.mark.parametrize(
    "subject, kind",
    [
        ("Face Value Split From Rs 10/- To Rs 2/-", "split"),
        ("Sub-Division 1:5", "split"),
        ("Bonus 1:1", "bonus"),
        ("Interim Dividend Rs 5 on face value of Rs 10", "dividend"),
        ("Dividend and Bonus 1:2", "bonus"),
        ("Dividend with Stock Split", "split"),
        ("Change in face value Rs 10 to Rs 5", "split"),
        ("Annual General Meeting", None),
    ],
)
def test_action_kind(spark, subject, kind):
    assert one(spark, subject, text.classify_action(F.col("s")).alias("k")).k == kind


def test_action_values(spark):
    c = F.col("s")
    assert one(spark, "Split From Rs 10/- To Rs 2/-", text.split_multiplier(c).alias("v")).v == 0.2
    assert one(spark, "Split 1:5", text.split_multiplier(c).alias("v")).v == 0.2
    assert one(spark, "Bonus 1:1", text.bonus_multiplier(c).alias("v")).v == 0.5
    both = "Dividend Rs 2 and Special Dividend Rs 3.50"
    assert one(spark, both, text.dividend_amount(c, F.lit(10.0)).alias("v")).v == 5.5
    assert one(spark, "Dividend and final dividend Rs 3", text.dividend_amount(c, F.lit(10.0)).alias("v")).v == 6.0
    assert one(spark, "Dividend 40%", text.dividend_amount(c, F.lit(10.0)).alias("v")).v == 4.0
    assert one(spark, "Dividend 40%", text.dividend_amount(c, F.lit(None).cast("double")).alias("v")).v is None


def test_filing_tags_search_the_whole_text(spark):
    from barloom.operators.fundamentals import parse_filings

    declared = '<doc xmlns:in-bse-fin="http://x/in-bse-fin/2020">'
    items = "x" * 50_000 + (
        "<in-bse-fin:PaidUpValueOfEquityShareCapital>0</in-bse-fin:PaidUpValueOfEquityShareCapital>"
        '<in-bse-fin:PaidUpValueOfEquityShareCapital c="1">1,000</in-bse-fin:PaidUpValueOfEquityShareCapital>'
        "<in-bse-fin:FaceValueOfEquityShareCapital>10</in-bse-fin:FaceValueOfEquityShareCapital>"
        "<in-bse-fin:BorrowingsCurrent>7e2</in-bse-fin:BorrowingsCurrent><other:Assets>5</other:Assets>"
    )
    docs = [(declared + items,), (items,), (items + declared,), (declared.replace("http://x/in-bse-fin/2020", "urn:other") + items,), (None,)]
    r, *others = parse_filings(spark.createDataFrame(docs, "text string").coalesce(1)).collect()
    assert (r.shares_outstanding, r.total_debt, r.total_assets) == (100.0, 700.0, None)
    assert "total_assets" in r.unmapped_items and "total_debt" not in r.unmapped_items
    for o in others:  # nothing unless the standard's address is declared near the begin
        assert o.shares_outstanding is None and o.total_debt is None and len(o.unmapped_items) == 8


def test_range_numbers_rise_with_values_of_any_size(spark):
    rng = random.Random(6)
    values = [rng.choice([-1, 1]) * 10 ** rng.uniform(-320, 308) for _ in range(400)]
    values += [1 + k * 1e-6 for k in range(400)] + [0.0, -0.0, float("inf"), float("-inf"), 5e-324, 1.7e308, -1.7e308, None, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    rows = df.withColumn("b", scan.range_number(df, "x")).orderBy("x").collect()
    numbers = [r.b for r in rows]
    assert numbers == sorted(numbers) and rows[0].x is None and numbers[0] < numbers[1] and numbers[-1] > numbers[-2]
    near = spark.createDataFrame([(1 + k * 1e-6,) for k in range(1000)], "x double")
    assert near.select(scan.range_number(near, "x").alias("b")).distinct().count() > 150
    whole = spark.createDataFrame([(k,) for k in range(-50, 50)], "x long")
    got = scan.prefix_sums(whole.withColumn("n", F.lit(1)), "x", ["n"]).collect()
    assert {r.x: r.before_n for r in got} == {k: k + 50 for k in range(-50, 50)}


def test_quantiles_start_no_job_while_planned(spark):
    df = spark.range(1000).select((F.col("id") % 17).cast("double").alias("x"))
    jobs = spark.sparkContext.statusTracker()
    before = len(jobs.getJobIdsForGroup(None))
    planned = scan.quantiles(df, "x", {"m": 0.5})
    assert len(jobs.getJobIdsForGroup(None)) == before
    assert planned.first().m == 8.0
