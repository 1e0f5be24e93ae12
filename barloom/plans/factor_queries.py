"""Registered queries: recursive averages, factors, universe, breadth and regimes."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.windows import sma
from barloom.operators import calendar, factors, fundamentals, indicators, regime, trades
from barloom.plans.oracle_views import WEEK_FRI, cte, ema_sql, mean_sql, rnd, rounded, wilder_sql
from barloom.plans.registry import query
from barloom.sources.views import LIQUIDITY_FLOOR, UNIVERSE_BUFFER, UNIVERSE_SIZE

c = F.col
DATE = "CAST(date AS VARCHAR) AS date"
W = "WINDOW w AS (PARTITION BY isin ORDER BY date)"

cte("prices", "bars", """
SELECT symbol AS isin, date, open, high, low, close, volume, traded_value, median(traded_value) OVER (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING) AS adv_20,
 row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS bar FROM bars""")
cte("vix", "idx", "SELECT date, 14.0::DOUBLE + day(date) % 13 AS vix FROM idx WHERE day(date) % 7 <> 0")
query("w01_ema", "prices", f"SELECT isin, {DATE}, {rnd(ema_sql('close', 21))} AS ema FROM prices {W}")(
    lambda v: factors.ema(v.prices, 21).select("isin", "date", "ema"))
query("w02_sma", "prices", f"SELECT isin, {DATE}, {rnd('CASE WHEN bar >= 49 THEN avg(close) OVER (PARTITION BY isin ORDER BY date ROWS 49 PRECEDING) END')} AS sma FROM prices")(
    lambda v: v.prices.select("isin", "date", sma(c("close"), 50, ["isin"]).alias("sma")))
cte("macdp", "prices", f"""SELECT *, {ema_sql('macd', 9)} AS macd_signal FROM (SELECT *, {ema_sql('close', 12)} - {ema_sql('close', 26)} AS macd FROM prices {W}) {W}""")
query("w03_macd", "macdp", f"SELECT isin, {DATE}, {rounded('macd macd_signal')} FROM macdp")(
    lambda v: factors.macd(v.prices).select("isin", "date", "macd", "macd_signal"))
TR = "greatest(high - low, abs(high - pc), abs(low - pc))"
cte("atrp", "macdp", f"""
SELECT *, {wilder_sql('tr', 20, 'seed')} AS atr, {wilder_sql('volume', 14, 'vseed')} AS rma FROM (SELECT *, avg(tr) OVER (PARTITION BY isin ORDER BY date ROWS 19 PRECEDING) AS seed,
 avg(volume) OVER (PARTITION BY isin ORDER BY date ROWS 13 PRECEDING) AS vseed FROM (SELECT *, {TR} AS tr FROM (
 SELECT *, lag(close) OVER w AS pc FROM macdp {W}))) {W}""")
query("w04_wilder_average", "atrp", f"SELECT isin, {DATE}, {rnd('rma')} AS rma FROM atrp")(
    lambda v: factors.wilder_average(v.prices, c("volume"), 14).select("isin", "date", "rma"))
query("w05_atr", "atrp", f"SELECT isin, {DATE}, {rnd('atr')} AS atr FROM atrp")(lambda v: factors.atr(v.prices, 20).select("isin", "date", "atr"))
cte("wmacd", "prices", f"""
SELECT isin, date, {ema_sql('close', 12)} - {ema_sql('close', 26)} AS w_macd FROM (SELECT *, row_number() OVER (PARTITION BY isin ORDER BY date) - 1 AS bar FROM (
 SELECT isin, {WEEK_FRI} AS date, arg_max(close, p.date) AS close FROM prices p GROUP BY isin, {WEEK_FRI})) {W}""".replace("arg_max(close, p.date)", "arg_max(close, date)"))
query("j07_weekly_macd", "wmacd prices", f"SELECT p.isin, CAST(p.date AS VARCHAR) AS date, {rnd('w_macd')} AS w_macd FROM prices p ASOF LEFT JOIN wmacd m ON m.isin = p.isin AND p.date >= m.date")(
    lambda v: factors.weekly_macd(v.prices))
query("w07_boolean_signals", "panel", f"""
SELECT timeframe, symbol, {DATE}, signal_ema_cross, signal_pullback_21, signal_macd_bullish, overextended,
 coalesce(CASE timeframe WHEN 'D' THEN (signal_ema_cross OR signal_pullback_21 OR coalesce(ema5 > ema13 AND ema13 > ema21, false)) AND signal_macd_bullish
  AND rsi > 35 AND rsi <= 65 AND close > ema200 AND adx >= 20 WHEN 'W' THEN rsi > 50 AND close > ema21 ELSE rsi > 50 AND (close > ema13 OR close > ema21) END, false) AS bullish_flag
FROM (SELECT *, coalesce(ema5 > ema13 AND lag(ema5) OVER w <= lag(ema13) OVER w, false) AS signal_ema_cross, coalesce(ema5 > ema13 AND close > ema21 AND abs(close - ema21)/ema21 < 0.03, false) AS signal_pullback_21,
 coalesce(macd > macd_signal, false) AS signal_macd_bullish, coalesce(rsi > 80, false) AS overextended FROM panel WINDOW w AS (PARTITION BY timeframe, symbol ORDER BY date))""")(
    lambda v: indicators.boolean_signals(v.panel).select(
        "timeframe", "symbol", "date", "signal_ema_cross", "signal_pullback_21", "signal_macd_bullish", "overextended", "bullish_flag"))
query("w09_consolidation", "signals", f"SELECT symbol, {DATE}, is_consolidating FROM signals WHERE timeframe = 'D'")(
    lambda v: v.panel.filter("timeframe = 'D'").select("symbol", "date", indicators.is_consolidating(15, 12.0).alias("is_consolidating")))
query("w10_rs_ranks", "signals idx", f"""
SELECT symbol, {DATE}, rs_score, {rnd('momentum_12m - b')} AS excess_12m FROM signals LEFT JOIN (SELECT date, (level/lag(level, 251) OVER (ORDER BY date) - 1)*100 AS b FROM idx) USING (date)
WHERE timeframe = 'D' AND momentum_12m IS NOT NULL""")(
    lambda v: indicators.rs_ranks_vs_index(v.scored, v.index, v.parts).select("symbol", "date", "rs_score", "excess_12m"))
MOM = lambda skip, look: f"CASE WHEN lag(close, {look}) OVER w <> 0 THEN {'close' if not skip else f'lag(close, {skip}) OVER w'}/lag(close, {look}) OVER w - 1 END"
VOL = "CASE WHEN count(ret) OVER v >= 63 THEN stddev_samp(ret) OVER v * sqrt(252::DOUBLE) END"
cte("factorsw", "prices", f"""
SELECT isin, date, {MOM(21, 273)} AS mom_12_1, {MOM(21, 147)} AS mom_6_1, -({VOL}) AS low_vol,
 CASE WHEN count(ret) OVER v >= 63 THEN avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret IS NOT NULL THEN 0.0 END) OVER v END AS trend_quality, -({MOM(0, 21)}) AS reversal
FROM (SELECT *, close/lag(close) OVER w - 1 AS ret FROM prices {W}) WINDOW w AS (PARTITION BY isin ORDER BY date), v AS (PARTITION BY isin ORDER BY date ROWS 125 PRECEDING)""")
for code, col in (("w15", "mom_12_1"), ("w13", "mom_6_1"), ("w16", "low_vol"), ("w17", "trend_quality"), ("w18", "reversal")):
    query(f"{code}_{col}", "factorsw", f"SELECT isin, {DATE}, {rnd(col)} AS {col} FROM factorsw")(
        lambda v, col=col: factors.price_factors(v.prices).select("isin", "date", col))
cte("gatep", "prices", f"""
SELECT isin, date, close, adv_20, {ema_sql('close', 200, seed='seed')} AS ema200, {MOM(21, 273)} AS momentum_12_1, {VOL} AS annualized_vol
FROM (SELECT *, close/lag(close) OVER w - 1 AS ret, avg(close) OVER (PARTITION BY isin ORDER BY date ROWS 199 PRECEDING) AS seed FROM prices {W})
WINDOW w AS (PARTITION BY isin ORDER BY date), v AS (PARTITION BY isin ORDER BY date ROWS 125 PRECEDING)""")
query("w14_gate_panel", "gatep", f"SELECT isin, {DATE}, {rounded('ema200 momentum_12_1 annualized_vol')} FROM gatep")(
    lambda v: factors.gate_panel(v.prices).select("isin", "date", "ema200", "momentum_12_1", "annualized_vol"))
GATE = f"coalesce(close > ema200 AND adv_20 >= {LIQUIDITY_FLOOR} AND momentum_12_1 > 0, false)"
query("p14_entry_gate", "gatep", f"SELECT isin, {DATE}, {GATE} AS open FROM gatep")(
    lambda v: factors.gate_panel(v.prices).select("isin", "date", factors.entry_gate(LIQUIDITY_FLOOR).alias("open")))
query("w19_vol_adjusted_ranker", "gatep", f"SELECT isin, {DATE}, {rnd('CASE WHEN annualized_vol <> 0 THEN momentum_12_1/annualized_vol END')} AS score FROM gatep")(
    lambda v: factors.gate_panel(v.prices).select("isin", "date", factors.ranker().alias("score")))
query("w21_eligible_ranked", "gatep", f"""
SELECT {DATE}, isin, {rnd('s')} AS score, row_number() OVER (PARTITION BY date ORDER BY s DESC, isin) AS rank FROM (SELECT *, momentum_12_1/annualized_vol AS s FROM gatep WHERE {GATE}) WHERE s IS NOT NULL""")(
    lambda v: factors.eligible_ranked(factors.gate_panel(v.prices), factors.ranker(), factors.entry_gate(LIQUIDITY_FLOOR)))
cte("swing", "atrp wmacd", f"""
SELECT a.*, m.w_macd FROM (SELECT *, {ema_sql('close', 50)} AS ema_exit, CASE WHEN bar >= 19 THEN avg(close) OVER (PARTITION BY isin ORDER BY date ROWS 19 PRECEDING) END AS sma_short,
 CASE WHEN bar >= 49 THEN avg(close) OVER (PARTITION BY isin ORDER BY date ROWS 49 PRECEDING) END AS sma_mid, CASE WHEN bar >= 199 THEN avg(close) OVER (PARTITION BY isin ORDER BY date ROWS 199 PRECEDING) END AS sma_long,
 close/lag(close, 126) OVER w - 1 AS mom, lag(macd) OVER w AS pm, lag(macd_signal) OVER w AS ps FROM atrp {W}) a ASOF LEFT JOIN wmacd m ON m.isin = a.isin AND a.date >= m.date""")
query("w20_swing_signals", "swing", f"""
SELECT isin, {DATE}, {rounded('ema_exit atr mom')}, CASE WHEN w_macd IS NOT NULL AND sma_long IS NOT NULL THEN w_macd > 0 AND close > sma_long AND sma_short > sma_mid AND coalesce(macd > macd_signal AND pm <= ps, false) END AS entry,
 coalesce(macd < macd_signal AND pm >= ps, false) AS exit_macd_cross_down FROM swing""")(
    lambda v: factors.swing_signals(v.prices).select("isin", "date", "ema_exit", "atr", "mom", "entry", "exit_macd_cross_down"))
NAMES = ("mom_12_1", "low_vol", "trend_quality")
cte("franks", "factorsw", """
SELECT isin, date, factor, value, CASE WHEN value IS NOT NULL THEN (rank() OVER (PARTITION BY factor, date ORDER BY value NULLS LAST) + (count(*) OVER (PARTITION BY factor, date, value) - 1)/2.0::DOUBLE)
 / count(value) OVER (PARTITION BY factor, date) END AS r FROM factorsw UNPIVOT INCLUDE NULLS (value FOR factor IN (mom_12_1, mom_6_1, low_vol, trend_quality, reversal))""")
IN = "factor IN ('mom_12_1', 'low_vol', 'trend_quality')"
long3 = lambda v: factors.long_factors(factors.price_factors(v.prices), factors.PRICE_FACTORS)
cte("comp", "franks", f"SELECT date, isin, CASE WHEN count(r) = 3 THEN sum(r)/3 END AS composite FROM franks WHERE {IN} GROUP BY date, isin")
query("w22_composite_rank", "comp", f"SELECT {DATE}, isin, {rnd('composite')} AS composite FROM comp")(lambda v: factors.composite_rank(long3(v), NAMES))
query("w22_composite_smoothed", "comp", f"SELECT {DATE}, isin, {rnd('avg(composite) OVER (PARTITION BY isin ORDER BY date ROWS 62 PRECEDING)')} AS composite FROM comp")(
    lambda v: factors.composite_rank(long3(v), NAMES, smoothing_months=3))
query("f32_factor_weights", "franks", f"SELECT {DATE}, isin, {rnd('CASE WHEN count(r) = 3 THEN sum(r*CASE factor WHEN {0} THEN 0.5::DOUBLE WHEN {1} THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END) END')} AS composite FROM franks WHERE {IN} GROUP BY date, isin".replace("{0}", "'mom_12_1'").replace("{1}", "'low_vol'"))(
    lambda v: factors.composite_rank(long3(v), NAMES, {"mom_12_1": 5, "low_vol": 3, "trend_quality": 2}))
query("w22_composite_of_present", "franks", f"SELECT {DATE}, isin, {rnd('avg(r)')} AS composite FROM franks WHERE {IN} GROUP BY date, isin")(
    lambda v: factors.composite_rank(long3(v), NAMES, require_all=False))
cte("cover", "factorsw", "SELECT date, factor, count(value)*1.0::DOUBLE/count(*) AS coverage FROM factorsw UNPIVOT INCLUDE NULLS (value FOR factor IN (mom_12_1, mom_6_1, low_vol, trend_quality, reversal)) GROUP BY 1, 2")
query("a30_factor_coverage", "cover", f"SELECT factor, {rnd('avg(coverage)')} AS mean, {rnd('min(coverage)')} AS min, {rnd('max(coverage)')} AS max FROM cover GROUP BY factor")(
    lambda v: factors.coverage_summary(factors.factor_coverage(long3(v))))
query("a31_spearman_by_date", "factorsw", f"""
SELECT {DATE}, count(*) AS n, {rnd('corr(ra, rb)')} AS rho FROM (SELECT date, rank() OVER (PARTITION BY date ORDER BY mom_12_1) + (count(*) OVER (PARTITION BY date, mom_12_1) - 1)/2.0::DOUBLE AS ra,
 rank() OVER (PARTITION BY date ORDER BY low_vol) + (count(*) OVER (PARTITION BY date, low_vol) - 1)/2.0::DOUBLE AS rb FROM factorsw WHERE mom_12_1 IS NOT NULL AND low_vol IS NOT NULL) GROUP BY date HAVING count(*) >= 5""")(
    lambda v: factors.spearman_by_date(factors.price_factors(v.prices), "mom_12_1", "low_vol"))
query("a32_block_mean", "factorsw", f"SELECT isin, {DATE}, {rnd('list_avg([mom_12_1, mom_6_1, reversal])')} AS block FROM factorsw")(
    lambda v: factors.price_factors(v.prices).select("isin", "date", factors.block_mean(["mom_12_1", "mom_6_1", "reversal"]).alias("block")))
query("a48_pooled_correlation", "factorsw", f"SELECT {rnd('corr(mom_12_1, low_vol)')} AS corr, count(*) AS n FROM factorsw WHERE mom_12_1 IS NOT NULL AND low_vol IS NOT NULL")(
    lambda v: factors.pooled_corr(factors.price_factors(v.prices), "mom_12_1", "low_vol"))


def sparse(v):
    f = factors.price_factors(v.prices)
    return factors.sparse_mean([
        f.filter(F.dayofmonth("date") % 2 == 0).select("date", "isin", c("mom_6_1").alias("value")),
        f.filter(c("isin") % 3 != 0).select("date", "isin", c("low_vol").alias("value"))])


query("u06_sparse_union_mean", "factorsw", f"""
SELECT {DATE}, isin, {rnd('avg(value)')} AS value FROM (SELECT date, isin, mom_6_1 AS value FROM factorsw WHERE day(date) % 2 = 0 UNION ALL SELECT date, isin, low_vol FROM factorsw WHERE isin % 3 <> 0) GROUP BY 1, 2""")(sparse)

# --- universe -----------------------------------------------------------------
cte("snap", "prices reviews", f"""
SELECT k, date, isin, row_number() OVER (PARTITION BY date ORDER BY liq DESC, isin) AS rank FROM (
 SELECT isin, date, CASE WHEN bar >= 125 THEN median(adv_20) OVER (PARTITION BY isin ORDER BY date ROWS 125 PRECEDING) END AS liq FROM prices)
JOIN (SELECT date, row_number() OVER (ORDER BY date) AS k FROM reviews) USING (date) WHERE liq IS NOT NULL""")
SIZE = 8
MEMBERS = f"""WITH RECURSIVE m AS (SELECT k, date, isin, rank, rank <= {SIZE} AS inside FROM snap WHERE (k - 1, isin) NOT IN (SELECT (k, isin) FROM snap)
UNION ALL SELECT s.k, s.date, s.isin, s.rank, s.rank <= {SIZE} OR (m.inside AND s.rank <= {SIZE * UNIVERSE_BUFFER}) FROM m JOIN snap s ON s.k = m.k + 1 AND s.isin = m.isin)"""
revs = lambda v: calendar.review_days(calendar.trading_days(v.bars))
members = lambda v: factors.stable_universe(v.prices, revs(v), SIZE, UNIVERSE_BUFFER)
query("w29_stable_universe", "snap", f"{MEMBERS} SELECT CAST(date AS VARCHAR) AS review, isin, rank FROM m WHERE inside".replace("WITH RECURSIVE", "WITH"))(members)
query("w29_universe_days", "snap prices", f"""
{MEMBERS} SELECT p.isin, CAST(p.date AS VARCHAR) AS date FROM prices p ASOF JOIN reviews r ON p.date >= r.date JOIN m ON m.date = r.date AND m.isin = p.isin WHERE m.inside""".replace("WITH RECURSIVE", "WITH").strip())(
    lambda v: factors.universe_days(v.prices, revs(v), members(v)))

# --- breadth and regime ---------------------------------------------------------
cte("internals", "prices", f"""
SELECT date, count(*) FILTER (WHERE delta > 0) AS advancers, count(*) FILTER (WHERE delta < 0) AS decliners, count(*) FILTER (WHERE delta = 0) AS unchanged, count(delta) AS total,
 count(*) FILTER (WHERE delta > 0 AND liq) AS liq_advancers, count(*) FILTER (WHERE delta < 0 AND liq) AS liq_decliners, count(*) FILTER (WHERE delta IS NOT NULL AND liq) AS liq_total
FROM (SELECT date, adv_20 >= {LIQUIDITY_FLOOR} AS liq, CASE WHEN o - lag(o) OVER w = 1 THEN close - lag(close) OVER w END AS delta
 FROM prices JOIN (SELECT date, row_number() OVER (ORDER BY date) AS o FROM (SELECT DISTINCT date FROM prices)) USING (date) {W}) GROUP BY date""")
cte("internals2", "internals", """
SELECT *, CASE WHEN advancers + decliners > 0 THEN advancers*100.0::DOUBLE/(advancers + decliners) END AS breadth_pct, CAST(advancers AS DOUBLE)/CASE WHEN decliners > 0 THEN decliners ELSE 1 END AS ad_ratio,
 CASE WHEN liq_advancers + liq_decliners > 0 THEN liq_advancers*100.0::DOUBLE/(liq_advancers + liq_decliners) END AS liq_breadth_pct, CAST(liq_advancers AS DOUBLE)/CASE WHEN liq_decliners > 0 THEN liq_decliners ELSE 1 END AS liq_ad_ratio FROM internals""")
internals = lambda v: regime.market_internals(v.prices, LIQUIDITY_FLOOR)
RATES = "breadth_pct ad_ratio liq_breadth_pct liq_ad_ratio"
query("a05_market_internals", "internals2", f"SELECT {DATE}, advancers, decliners, unchanged, total, liq_advancers, liq_decliners, liq_total, {rounded(RATES)} FROM internals2")(internals)
query("f30_breadth_ratios", "internals2", f"SELECT {DATE}, {rounded('breadth_pct ad_ratio')} FROM internals2")(
    lambda v: internals(v).select("date", regime.breadth_pct(c("advancers"), c("decliners")).alias("breadth_pct"), regime.ad_ratio(c("advancers"), c("decliners")).alias("ad_ratio")))
query("j09_volatility_join", "internals vix", f"SELECT {DATE}, total, {rnd('vix')} AS vix FROM internals LEFT JOIN vix USING (date)")(
    lambda v: regime.with_volatility(internals(v), v.volatility).select("date", "total", "vix"))
query("a06_ema_breadth", "panel", f"SELECT {DATE}, {rnd('avg(CASE WHEN close > ema200 THEN 100.0 ELSE 0 END)')} AS breadth_pct, count(*) AS stock_count FROM panel WHERE timeframe = 'D' AND ema200 IS NOT NULL GROUP BY date")(
    lambda v: regime.ema_breadth(v.panel.filter("timeframe = 'D'")))
query("a07_top_cap_breadth", "panel stocks", f"""
SELECT {DATE}, {rnd('avg(CASE WHEN close > ema200 THEN 100.0 ELSE 0 END)')} AS breadth_pct, count(*) AS stock_count FROM panel WHERE timeframe = 'D' AND ema200 IS NOT NULL
 AND symbol IN (SELECT symbol FROM stocks WHERE market_cap IS NOT NULL ORDER BY market_cap DESC, symbol LIMIT 5) GROUP BY date""")(
    lambda v: regime.top_cap_breadth(v.panel.filter("timeframe = 'D'"), v.stocks, 5))
cte("idxma", "idx", """
SELECT date, level, CASE WHEN n >= 200 THEN avg(level) OVER (ORDER BY date ROWS 199 PRECEDING) END AS dl, CASE WHEN n >= 50 THEN avg(level) OVER (ORDER BY date ROWS 49 PRECEDING) END AS ds
FROM (SELECT *, row_number() OVER (ORDER BY date) AS n FROM idx)""")
cte("debounced", "idxma", """
SELECT date, coalesce(last_value(mark IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING), 1.0) AS fraction FROM (
 SELECT date, CASE WHEN n >= 3 AND min(above) OVER v = 1 THEN 1.0 WHEN n >= 3 AND max(above) OVER v = 0 THEN 0.0 END AS mark FROM (
  SELECT date, row_number() OVER (ORDER BY date) AS n, CASE WHEN dl IS NULL OR level > dl THEN 1 ELSE 0 END AS above FROM idxma) WINDOW v AS (ORDER BY date ROWS 2 PRECEDING))""")
query("w24_debounced_regime", "debounced", f"SELECT {DATE}, {rnd('fraction')} AS fraction FROM debounced")(lambda v: regime.debounced_fraction(v.index))
cte("rscore", "internals2 vix idxma", """
SELECT i.date, CAST(coalesce(level > dl, false) AS INTEGER) + CAST(coalesce(ds > dl, false) AS INTEGER) + CAST(coalesce(liq_breadth_pct > 60, false) AS INTEGER)
 + CAST(coalesce(liq_ad_ratio > 1, false) AS INTEGER) + CAST(coalesce(vix < 20, false) AS INTEGER) AS score FROM internals2 i LEFT JOIN vix USING (date) ASOF LEFT JOIN idxma m ON i.date >= m.date""")
scores = lambda v: regime.regime_score(v.index, regime.with_volatility(internals(v), v.volatility))
query("w26_regime_score", "rscore", f"SELECT {DATE}, score, {rnd('CASE WHEN score <= 1 THEN 0.0 WHEN score >= 4 THEN 1.0 ELSE 0.5 END')} AS fraction FROM rscore")(scores)
query("w28_linear_ramp", "rscore", f"SELECT {DATE}, {rnd('score/5.0')} AS fraction FROM rscore")(lambda v: regime.linear_ramp(scores(v)))
query("w27_timer", "idxma nav", f"SELECT CAST(n.date AS VARCHAR) AS date, {rnd('CASE WHEN coalesce(level > dl, false) THEN 1.0 ELSE 0.0 END')} AS fraction FROM nav n ASOF LEFT JOIN idxma m ON n.date >= m.date")(
    lambda v: regime.timer_fraction(v.index, v.nav.select("date")))
cte("asks", "idxpanel panel", """
SELECT date, row_number() OVER (ORDER BY date) AS k, CASE WHEN close < coalesce(ema200, 0) OR r < 45 THEN 0 WHEN a < 15 AND b > 60 THEN 2 WHEN a < 15 AND b < 40 THEN 0
 WHEN a >= 15 AND r > 60 AND a > 20 THEN 2 WHEN r >= 50 THEN 3 ELSE 1 END AS ask FROM (SELECT i.date, i.close, i.ema200, coalesce(i.rsi, 50) AS r, coalesce(i.adx, 0) AS a, coalesce(br.b, 100) AS b
 FROM idxpanel i LEFT JOIN (SELECT date, avg(CASE WHEN close > ema200 THEN 100.0 ELSE 0 END) AS b FROM panel WHERE timeframe = 'D' AND ema200 IS NOT NULL GROUP BY date) br USING (date))""")
query("w25_three_state_regime", "asks", f"""
WITH states AS (SELECT CAST(0 AS BIGINT) AS k, 1 AS state, 0 AS streak UNION ALL SELECT k, CASE WHEN want <> state AND streak + 1 >= 5 THEN want ELSE state END,
 CASE WHEN want = state OR streak + 1 >= 5 THEN 0 ELSE streak + 1 END FROM (SELECT a.k, w.state, w.streak, CASE WHEN a.ask = 3 THEN CASE WHEN w.state = 2 THEN 2 ELSE 1 END ELSE a.ask END AS want FROM states w JOIN asks a ON a.k = w.k + 1))
SELECT CAST(-1 AS BIGINT) AS symbol, {DATE}, state AS regime FROM states JOIN asks USING (k)""")(lambda v: regime.three_state(
    indicators.indicator_panel(v.index_bars, even=None), regime.ema_breadth(v.panel.filter("timeframe = 'D'"))))
query("w56_index_trend", "idx", f"""
SELECT level > e50 AND level > e200 AND e50 > e200 AS bullish FROM (SELECT *, {ema_sql('level', 50, seed='s50').replace('OVER w', 'OVER (ORDER BY date)')} AS e50, {ema_sql('level', 200, seed='s200').replace('OVER w', 'OVER (ORDER BY date)')} AS e200 FROM (
 SELECT *, row_number() OVER (ORDER BY date) - 1 AS bar, avg(level) OVER (ORDER BY date ROWS 49 PRECEDING) AS s50, avg(level) OVER (ORDER BY date ROWS 199 PRECEDING) AS s200 FROM idx)) ORDER BY date DESC LIMIT 1""")(
    lambda v: regime.index_trend(v.index))


def index_signals(v):
    from barloom.operators.indicators import indicator_panel, score_signals

    return score_signals(indicator_panel(v.index_bars, even=None)).select("date", (c("close") > c("ema200")).alias("is_bullish")).filter(F.dayofmonth("date") % 5 == 0)


query("j05_regime_on_day", "idxpanel nav", f"""
SELECT CAST(n.date AS VARCHAR) AS date, coalesce(s.b, true) AS bullish FROM nav n ASOF LEFT JOIN (SELECT date, close > ema200 AS b FROM idxpanel WHERE day(date) % 5 = 0) s ON n.date >= s.date""")(
    lambda v: regime.bullish_on(v.nav.select("date"), index_signals(v)))
query("j06_timeframe_state", "signals bars", f"""
SELECT b.symbol, CAST(b.date AS VARCHAR) AS date, CASE WHEN b.symbol NOT IN (SELECT symbol FROM signals WHERE timeframe = 'W' AND symbol % 4 <> 0) THEN true ELSE coalesce(s.is_bullish, false) END AS confirmed
FROM bars b ASOF LEFT JOIN (SELECT * FROM signals WHERE timeframe = 'W' AND symbol % 4 <> 0) s ON s.symbol = b.symbol AND b.date >= s.date""")(
    lambda v: regime.timeframe_state(v.bars, v.scored.filter("timeframe = 'W' AND symbol % 4 <> 0")))
query("j08_aligned_benchmark", "idx nav", f"""
SELECT {DATE}, {rnd('level/first_value(level) OVER (ORDER BY date)*1000000')} AS level FROM (SELECT n.date, i.level FROM nav n ASOF LEFT JOIN idx i ON n.date >= i.date WHERE n.date >= DATE '1996-01-01')""")(
    lambda v: regime.align_benchmark(v.index, v.nav.select("date"), "1996-01-01", 1e6))
query("j30_excess_over_index", "prices idx", f"""
SELECT isin, {DATE}, {rnd('m - b')} AS excess FROM (SELECT isin, date, close/lag(close, 126) OVER w - 1 AS m FROM prices {W}) JOIN (SELECT date, level/lag(level, 126) OVER (ORDER BY date) - 1 AS b FROM idx) USING (date) WHERE m IS NOT NULL""")(
    lambda v: trades.excess_over_index(v.prices, v.index))
query("a41_regime_profile", "debounced nav", f"""
WITH r AS (SELECT max(date) AS date FROM debounced GROUP BY date_trunc('month', date))
SELECT CAST(sum(CASE WHEN fraction <> p THEN 1 ELSE 0 END) AS BIGINT) AS transitions, {rnd('avg(CASE WHEN fraction < 1 THEN 100.0 ELSE 0 END)')} AS risk_off_pct,
 (SELECT CAST(sum(CASE WHEN fraction <> p THEN 1 ELSE 0 END) AS BIGINT) FROM (SELECT fraction, lag(fraction) OVER (ORDER BY date) AS p FROM debounced JOIN r USING (date))) AS rebalance_flips
FROM (SELECT *, lag(fraction) OVER (ORDER BY date) AS p FROM debounced)""")(
    lambda v: regime.regime_profile(regime.debounced_fraction(v.index), calendar.anchors(v.index.select("date"), "monthly")))
query("w53_sleeve_nav", "debounced idx", f"""
WITH b AS (SELECT date, coalesce(lag(fraction) OVER (ORDER BY date), 0.0) AS w, coalesce(level/lag(level) OVER (ORDER BY date), 1.0) AS r, CASE WHEN lag(level) OVER (ORDER BY date) IS NULL THEN 1.0 ELSE 1.0002::DOUBLE END AS g FROM idx JOIN debounced USING (date)),
n AS (SELECT *, row_number() OVER (ORDER BY date) AS k, coalesce(w <> lag(w) OVER (ORDER BY date), false) AS sw FROM b),
x AS (SELECT *, ln(CASE WHEN w = 1 THEN r ELSE g END) + CASE WHEN sw THEN ln(1 - 0.001::DOUBLE) ELSE 0 END AS step FROM n)
SELECT {DATE}, {rnd('w')} AS w, {rnd('exp(sum(step) OVER (ORDER BY date))')} AS nav FROM x""")(
    lambda v: regime.sleeve_nav(regime.debounced_fraction(v.index), v.index, 0.0002, 0.001))

# --- fundamentals -----------------------------------------------------------------
ROLL = "CASE isodow({0}) WHEN 6 THEN {0} + 2 WHEN 7 THEN {0} + 1 ELSE {0} END"
CUT = "{0} - CASE WHEN isodow({0}) <= 2 THEN 4 ELSE 2 END"
cte("rdays", "bars", f"SELECT DISTINCT {ROLL.format('m')} AS date FROM (SELECT max(date) AS m FROM bars GROUP BY date_trunc('month', date))")
cte("onever", "filings", """
SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY isin, period_end, available_date ORDER BY statement_type) AS n FROM filings) WHERE n = 1""")
cte("seen", "onever rdays", f"""
SELECT * EXCLUDE (n) FROM (SELECT r.date AS as_of, o.*, row_number() OVER (PARTITION BY r.date, isin, period_end ORDER BY available_date DESC) AS n FROM rdays r JOIN onever o ON o.available_date <= {CUT.format('r.date')}) WHERE n = 1""")
rdays = lambda v: fundamentals.rebalance_days(calendar.trading_days(v.bars))
seen = lambda v: fundamentals.as_of(v.filings, rdays(v))
state = lambda v: fundamentals.states_on_days(fundamentals.filing_states(v.filings), rdays(v))
query("j16_fundamentals_as_of", "seen", f"SELECT CAST(as_of AS VARCHAR) AS as_of, isin, CAST(period_end AS VARCHAR) AS period_end, CAST(available_date AS VARCHAR) AS available_date, statement_type, {rounded('net_income cfo')} FROM seen")(
    lambda v: seen(v).select("as_of", "isin", "period_end", "available_date", "statement_type", "net_income", "cfo"))
TTM = "CASE WHEN count({0}) FILTER (WHERE q4) = 4 AND max(period_end) FILTER (WHERE q4) - min(period_end) FILTER (WHERE q4) <= 456 THEN sum({0}) FILTER (WHERE q4) ELSE max({0}) FILTER (WHERE statement_type = 'Annual' AND n = 1) END"
STK = "arg_max({0}, period_end) FILTER (WHERE {0} IS NOT NULL)"
cte("fstate", "seen", f"""
SELECT as_of, isin, {TTM.format('net_income')} AS ttm_net_income, {TTM.format('cfo')} AS ttm_cfo, {', '.join(STK.format(i) + ' AS ' + i for i in ('total_equity', 'total_assets', 'total_debt', 'shares_outstanding', 'debt_equity_ratio'))},
 coalesce(avg(total_equity) FILTER (WHERE statement_type = 'Annual' AND total_equity IS NOT NULL AND n <= 2), {STK.format('total_equity')}) AS avg_equity
FROM (SELECT *, n <= 4 AND statement_type = 'Quarterly' AS q4 FROM (SELECT *, row_number() OVER (PARTITION BY as_of, isin, statement_type ORDER BY period_end DESC) AS n FROM seen)) GROUP BY as_of, isin""")
ASOF = "CAST(as_of AS VARCHAR) AS as_of"
query("w50_ttm_flow", "fstate", f"SELECT {ASOF}, isin, {rounded('ttm_net_income ttm_cfo')} FROM fstate")(
    lambda v: state(v).select("as_of", "isin", "ttm_net_income", "ttm_cfo"))
query("w51_latest_items", "fstate", f"SELECT {ASOF}, isin, {rounded('total_assets total_debt debt_equity_ratio')} FROM fstate")(
    lambda v: state(v).select("as_of", "isin", "total_assets", "total_debt", "debt_equity_ratio"))
query("w52_average_equity", "fstate", f"SELECT {ASOF}, isin, {rounded('avg_equity')} FROM fstate")(
    lambda v: state(v).select("as_of", "isin", "avg_equity"))
cte("fframe", "fstate prices", """
SELECT p.isin, p.date, CASE WHEN shares_outstanding > 0 AND close*shares_outstanding > 0 THEN ttm_net_income/(close*shares_outstanding) END AS earnings_yield,
 CASE WHEN total_equity > 0 AND shares_outstanding > 0 THEN total_equity/(close*shares_outstanding) END AS book_to_price, CASE WHEN avg_equity > 0 THEN ttm_net_income/avg_equity END AS roe,
 CASE WHEN p.isin % 10 <> 7 AND total_assets > 0 THEN -(ttm_net_income - ttm_cfo)/total_assets END AS accruals,
 CASE WHEN p.isin % 10 <> 7 AND total_equity > 0 THEN coalesce(-(total_debt/total_equity), CASE WHEN debt_equity_ratio >= 0 THEN -debt_equity_ratio END) END AS leverage
FROM prices p JOIN rdays r ON r.date = p.date LEFT JOIN fstate f ON f.isin = p.isin AND f.as_of = p.date""")
frame = lambda v: fundamentals.factor_frame(v.filings, v.prices.withColumn("close_raw", c("close")), rdays(v), v.prices.filter("isin % 10 = 7"))
FUND = tuple(fundamentals.FUNDAMENTAL_FACTORS)
query("j29_fundamental_frame", "fframe", f"SELECT isin, {DATE}, {rounded(FUND)} FROM fframe")(frame)
for code, name in (("f17", "earnings_yield"), ("f18", "book_to_price"), ("f19", "roe"), ("f20", "accruals"), ("f21", "leverage")):
    query(f"{code}_{name}", "fframe", f"SELECT isin, {DATE}, {rnd(name)} AS {name} FROM fframe WHERE {name} IS NOT NULL")(
        lambda v, name=name: frame(v).select("isin", "date", name).filter(c(name).isNotNull()))
SHARES_ON = "prices p ASOF JOIN (SELECT isin, available_date, max(shares_outstanding) AS shares, max(total_equity) AS eq FROM filings GROUP BY 1, 2) f ON f.isin = p.isin AND p.date >= f.available_date"


def with_shares(v):
    from barloom.functions.asof import asof_join

    f = v.filings.groupBy("isin", "available_date").agg(F.max("shares_outstanding").alias("shares"), F.max("total_equity").alias("eq"))
    return asof_join(v.prices, f, ["isin"], "date", "available_date", ["shares", "eq"], unique_left=True).filter(c("shares").isNotNull())


query("f15_market_cap", "prices filings", f"SELECT p.isin, CAST(p.date AS VARCHAR) AS date, {rnd('close*shares')} AS cap FROM {SHARES_ON}")(
    lambda v: with_shares(v).select("isin", "date", fundamentals.market_cap(c("close"), c("shares")).alias("cap")))
query("f16_book_to_price_raw", "prices filings", f"SELECT p.isin, CAST(p.date AS VARCHAR) AS date, {rnd('eq/(close*shares)')} AS bp FROM {SHARES_ON}")(
    lambda v: with_shares(v).select("isin", "date", fundamentals.book_to_price(c("eq"), c("close"), c("shares")).alias("bp")))
value_long = lambda v: factors.long_factors(frame(v), ("earnings_yield", "book_to_price"))
cte("vrank", "fframe", """
SELECT date, isin, avg(r) AS value_rank FROM (SELECT date, isin, CASE WHEN value IS NOT NULL THEN (rank() OVER (PARTITION BY factor, date ORDER BY value NULLS LAST) + (count(*) OVER (PARTITION BY factor, date, value) - 1)/2.0::DOUBLE)
 / count(value) OVER (PARTITION BY factor, date) END AS r FROM (SELECT isin, date, earnings_yield, book_to_price FROM fframe) UNPIVOT INCLUDE NULLS (value FOR factor IN (earnings_yield, book_to_price))) GROUP BY 1, 2""")
query("a40_value_rank", "vrank", f"SELECT {DATE}, isin, {rnd('value_rank')} AS value_rank FROM vrank")(lambda v: factors.value_rank(value_long(v)))
query("w23_value_tilt", "vrank comp", f"""
SELECT CAST(k.date AS VARCHAR) AS date, k.isin, {rnd('composite + 0.5*coalesce(r.value_rank, 0.5)')} AS tilted FROM comp k ASOF LEFT JOIN (SELECT * FROM vrank WHERE value_rank IS NOT NULL) r ON r.isin = k.isin AND k.date >= r.date""")(
    lambda v: factors.value_tilt(factors.composite_rank(long3(v), NAMES), factors.value_rank(value_long(v)), 0.5).select("date", "isin", "tilted"))
ELIG = f"SELECT p.date, p.isin, adv_20 AS weight FROM prices p JOIN rdays USING (date) WHERE adv_20 >= {LIQUIDITY_FLOOR}"
cte("elig", "prices rdays", ELIG)
cte("covered", "fframe", "SELECT date, isin FROM fframe WHERE earnings_yield IS NOT NULL AND accruals IS NOT NULL")
elig = lambda v: v.prices.join(rdays(v), "date").filter(c("adv_20") >= LIQUIDITY_FLOOR).select("date", "isin", c("adv_20").alias("weight"))
good = lambda v: frame(v).filter("earnings_yield IS NOT NULL AND accruals IS NOT NULL").select("date", "isin")
query("j25_coverage", "elig covered filings", f"""
SELECT {DATE}, {rounded('name_pct weight_pct')}, name_pct < 0.75 OR weight_pct < 0.9 AS failed FROM (SELECT e.date, avg(CASE WHEN k.isin IS NULL THEN 0.0 ELSE 1.0 END) AS name_pct,
 sum(CASE WHEN k.isin IS NULL THEN 0.0 ELSE weight END)/sum(weight) AS weight_pct FROM elig e JOIN (SELECT isin, min(available_date) AS ff FROM filings GROUP BY isin) f ON f.isin = e.isin AND ff <= {CUT.format('e.date')}
 LEFT JOIN covered k ON k.isin = e.isin AND k.date = e.date GROUP BY e.date)""")(lambda v: fundamentals.coverage(elig(v), v.filings, good(v)))
query("w47_durable_start", "elig covered", f"""
WITH p AS (SELECT e.date, avg(CASE WHEN k.isin IS NULL THEN 0.0 ELSE 1.0 END) AS pct FROM elig e LEFT JOIN covered k ON k.isin = e.isin AND k.date = e.date GROUP BY e.date)
SELECT CAST(min(date) AS VARCHAR) AS start FROM p WHERE date > coalesce((SELECT max(date) FROM p WHERE pct < 0.2), DATE '1900-01-01')""")(
    lambda v: fundamentals.durable_start(elig(v).join(good(v).withColumn("_k", F.lit(1.0)), ["date", "isin"], "left").groupBy("date").agg(
        F.avg(F.coalesce("_k", F.lit(0.0))).alias("pct")), 0.2))
query("j26_share_reconciliation", "adjusted onever", f"""
WITH s AS (SELECT symbol AS isin, date, step FROM (SELECT *, adj_factor/lag(adj_factor) OVER (PARTITION BY isin ORDER BY date) AS step FROM adjusted) WHERE abs(step - 1) > 0.05),
v AS (SELECT isin, period_end, available_date, shares_outstanding*(1 + year(period_end) % 2) AS sh FROM onever),
k AS (SELECT *, {CUT.format(f"({ROLL.format('date')})")} AS c0, {CUT.format(f"({ROLL.format('(date + 400)')})")} AS c1 FROM s),
j AS (SELECT k.*, (SELECT max({{'p': period_end, 'a': available_date, 's': sh}}) FROM v WHERE v.isin = k.isin AND v.available_date <= c0) AS b, (SELECT max({{'p': period_end, 'a': available_date, 's': sh}}) FROM v WHERE v.isin = k.isin AND v.available_date <= c1) AS a FROM k)
SELECT isin, {DATE}, {rnd('step')} AS step, {rnd('a.s/b.s')} AS observed, abs(a.s/b.s - step)/step > 0.02 AS failed FROM j WHERE a.p > b.p""")(
    lambda v: fundamentals.share_reconciliation(
        fundamentals.factor_steps(v.adjusted).join(v.adjusted.select("isin", "date", "symbol"), ["isin", "date"]).select(c("symbol").alias("isin"), "date", "step"),
        v.filings.withColumn("shares_outstanding", c("shares_outstanding") * (1 + F.year("period_end") % 2))))
PITBAD = "SELECT isin, period_end, CASE WHEN isin % 10 = 3 THEN available_date - 60 ELSE available_date END AS available_date FROM filings"
pitbad = lambda v: v.filings.withColumn("available_date", F.when(c("isin") % 10 == 3, F.date_sub("available_date", 60)).otherwise(c("available_date")))
query("q09_point_in_time", "filings", f"""
SELECT isin, CAST(period_end AS VARCHAR) AS period_end, CAST(available_date AS VARCHAR) AS available_date, 'filed before period end' AS problem FROM ({PITBAD}) WHERE available_date <= period_end""")(
    lambda v: fundamentals.pit_violations(pitbad(v), seen(v)))
query("q10_replay_cases", "filings", f"""
SELECT isin, CAST(period_end AS VARCHAR) AS period_end, CAST(available_date AS VARCHAR) AS available_date, CAST(d AS VARCHAR) AS as_of, available_date <= {CUT.format('d')} AS visible FROM (
 SELECT *, unnest([{ROLL.format('available_date')}, {ROLL.format(f"({ROLL.format('(available_date + 1)')} + 6)").replace('END + 6)', 'END + 6)')}]) AS d FROM filings)""".replace(
    f"({ROLL.format('(available_date + 1)')} + 6)", f"(({ROLL.format('(available_date + 1)')}) + 6)"))(
    lambda v: fundamentals.replay_cases(v.filings))
query("q11_reconciliation", "filings", f"""
WITH n AS (SELECT isin, period_end, arg_max({{'a': net_income, 'b': total_equity}}, available_date) AS r, min(net_income) AS i2, min(total_equity) AS e2 FROM filings WHERE statement_type = 'Quarterly' GROUP BY 1, 2)
SELECT isin, CAST(period_end AS VARCHAR) AS period_end, item, {rnd('abs(o - t)/abs(t)')} AS rel_error, abs(o - t)/abs(t) > 0.02 AS failed FROM (
 SELECT isin, period_end, 'net_income' AS item, r.a AS o, i2 AS t FROM n UNION ALL SELECT isin, period_end, 'total_equity', r.b, e2 FROM n)""")(
    lambda v: fundamentals.reconciliation(v.filings.filter("statement_type = 'Quarterly'"), v.filings.filter("statement_type = 'Quarterly'").groupBy("isin", "period_end").agg(
        F.min("net_income").alias("net_income"), F.min("total_equity").alias("total_equity")), ["net_income", "total_equity"]))
DOC = """concat('<doc', CASE WHEN k % 7 = 0 THEN '' WHEN k % 7 = 1 THEN ' xmlns:in-bse-fin="urn:other"' ELSE ' xmlns:in-bse-fin="http://x/in-bse-fin/2020"' END, '><in-bse-fin:RevenueFromOperations contextRef="a"> ', CAST(c AS STRING), ' </in-bse-fin:RevenueFromOperations>',
 CASE WHEN k % 3 = 0 THEN concat('<in-bse-fin:Revenue unit="x">', CAST(c % 1000 AS STRING), '</in-bse-fin:Revenue>') ELSE '' END,
 CASE WHEN k % 2 = 0 THEN concat('<in-bse-fin:ProfitLossBeforeTax>', CAST(c AS STRING), '.5</in-bse-fin:ProfitLossBeforeTax><in-bse-fin:FinanceCosts>1,250</in-bse-fin:FinanceCosts>') ELSE '' END,
 CASE WHEN k % 5 = 0 THEN '<in-bse-fin:BorrowingsCurrent>700</in-bse-fin:BorrowingsCurrent>' ELSE '<in-bse-fin:Borrowings>n/a</in-bse-fin:Borrowings>' END,
 '<in-bse-fin:PaidUpValueOfEquityShareCapital>0</in-bse-fin:PaidUpValueOfEquityShareCapital><in-bse-fin:PaidUpValueOfEquityShareCapital>', CAST(k % 900 + 100 AS STRING), '</in-bse-fin:PaidUpValueOfEquityShareCapital>',
 '<in-bse-fin:FaceValueOfEquityShareCapital>10</in-bse-fin:FaceValueOfEquityShareCapital>', '<x:Assets>5</x:Assets>', t, '</doc>')"""


def filing_texts(v):
    """Document texts carrying filing tags next to their own prose."""
    orders = v.table("orders").select(c("o_orderkey").alias("k"), F.round(c("o_totalprice")).cast("long").alias("c"))
    docs = v.table("documents").select("doc_id", "text")
    return docs.join(orders, c("k") == c("doc_id")).select("doc_id", F.expr(DOC.replace(", t,", ", text,")).alias("text"))


cte("parsed", "", """SELECT doc_id, k % 7 > 1 AS known, CASE WHEN k % 7 <= 1 THEN NULL WHEN k % 3 = 0 THEN CAST(c % 1000 AS DOUBLE) ELSE CAST(c AS DOUBLE) END AS revenue,
 CASE WHEN k % 7 > 1 AND k % 2 = 0 THEN c + 0.5 + 1250 END AS ebit, CASE WHEN k % 7 > 1 AND k % 5 = 0 THEN 700.0 END AS total_debt, CASE WHEN k % 7 > 1 THEN (k % 900 + 100)/10.0 END AS shares_outstanding
FROM (SELECT doc_id, o_orderkey AS k, CAST(round(o_totalprice) AS BIGINT) AS c FROM documents JOIN orders ON o_orderkey = doc_id)""")
query("f13_filing_numbers", "parsed", f"SELECT doc_id, {rnd('revenue')} AS revenue FROM parsed")(
    lambda v: fundamentals.parse_filings(filing_texts(v)).select("doc_id", "revenue"))
query("f14_derived_items", "parsed", f"""
SELECT doc_id, {rounded('ebit total_debt shares_outstanding')}, CASE WHEN known THEN '' ELSE 'revenue,' END || 'net_income,' || CASE WHEN ebit IS NULL THEN 'ebit,' ELSE '' END || 'total_equity,total_assets,' || CASE WHEN total_debt IS NULL THEN 'total_debt,' ELSE '' END || CASE WHEN known THEN '' ELSE 'shares_outstanding,' END || 'cfo' AS unmapped FROM parsed""")(
    lambda v: fundamentals.parse_filings(filing_texts(v)).select("doc_id", "ebit", "total_debt", "shares_outstanding", F.array_join("unmapped_items", ",").alias("unmapped")))
