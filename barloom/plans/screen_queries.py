"""Registered queries: screens, alerts, dashboards."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from barloom.operators import alerts, dashboard, research, screens
from barloom.operators.indicators import SignalConfig
from barloom.plans.oracle_views import rnd, rounded
from barloom.plans.registry import query
from barloom.sources import storage
from barloom.sources.views import LIQUIDITY_FLOOR

DATE = "CAST(date AS VARCHAR) AS date"
D = "timeframe = 'D'"


RANKED = {"momentum_monsters"}  # the screens that read rs_score; the others need no ranks


def screen(name: str, slug: str, where: str, score: str = "entry_score") -> None:
    query(name, "signals", f"SELECT {DATE}, symbol, {rnd(score)} AS score FROM signals WHERE {D} AND {where}")(
        lambda v: screens.run_screen(slug, v.signals if slug in RANKED else v.scored, v.stocks))


WHERE = {
    "actionable_entries": "ema_signal = 'bullish_cross' AND above_200ema AND rsi >= 35 AND rsi <= 65 AND momentum_12m > 0 AND is_consolidating AND (volume_breakout OR adx >= 25)",
    "momentum_monsters": "rs_score >= 80 AND momentum_3m >= 15 AND adx >= 25 AND above_200ema AND rsi < 78",
    "ema_crossover": "ema_signal = 'bullish_cross' AND above_200ema AND adx >= 20 AND rsi >= 35 AND rsi < 70",
    "volume_surge": "volume_breakout AND above_200ema AND is_bullish AND rsi >= 35 AND rsi < 75",
    "rsi_recovery": "rsi_signal IN ('bullish_recovery', 'bullish_recovery_confirmed') AND above_200ema AND rsi >= 35 AND rsi <= 60 AND ema_slope_21 > 0",
    "near_52w_high": "pct_from_52w_high BETWEEN -5 AND 0 AND above_200ema AND is_bullish AND rsi < 78",
    "near_52w_low": "pct_from_52w_low BETWEEN 0 AND 15 AND rsi >= 35 AND rsi <= 55 AND ema_slope_21 > 0",
    "near_breakout": "pct_from_resistance BETWEEN -3 AND 0.5 AND above_200ema AND is_bullish AND rsi < 75 AND (volume_breakout OR ema_slope_21 > 0)",
    "fresh_52w_breakout": "pct_from_52w_high BETWEEN -1 AND 3 AND volume_breakout AND above_200ema AND rsi >= 50 AND rsi < 80 AND adx >= 20",
}
SCORE = {"momentum_monsters": "rs_score", "near_52w_high": "pct_from_52w_high", "near_52w_low": "rsi", "near_breakout": "pct_from_resistance"}
for code, slug in (("p01", "actionable_entries"), ("p02", "momentum_monsters"), ("p04", "ema_crossover"), ("p05", "volume_surge"),
                   ("p06", "rsi_recovery"), ("p07", "near_52w_high"), ("p08", "near_52w_low"), ("p09", "near_breakout"),
                   ("p10", "fresh_52w_breakout")):
    screen(f"{code}_{slug}", slug, WHERE[slug], SCORE.get(slug, "entry_score"))

MATERIAL = " UNION ALL ".join(
    f"SELECT '{s}' AS screen_slug, date, symbol, {SCORE.get(s, 'entry_score')} AS score, {'' if s == 'near_52w_low' else '-'}{SCORE.get(s, 'entry_score')} AS o "
    f"FROM signals WHERE {D} AND {w}" for s, w in WHERE.items())
RESULTS = f"SELECT screen_slug, date AS computed_at, symbol, score, row_number() OVER (PARTITION BY screen_slug, date ORDER BY o, symbol) AS rank FROM ({MATERIAL})"
PEG = "SELECT s_suppkey AS symbol, s_acctbal/2000.0 AS peg_ratio FROM supplier"


def ratios(v):
    return v.table("supplier").select(F.col("s_suppkey").alias("symbol"), (F.col("s_acctbal") / 2000.0).alias("peg_ratio"))


query("p03_growth_at_price", "signals", f"""
SELECT {DATE}, symbol, {rnd('entry_score')} AS score FROM signals JOIN ({PEG}) p USING (symbol)
WHERE {D} AND above_200ema AND rsi < 75 AND momentum_1m >= 5 AND ema_slope_21 > 0 AND peg_ratio > 0 AND peg_ratio < 2""")(
    lambda v: screens.growth_at_price(v.scored, v.stocks, ratios(v)))
query("p11_liquidity_gate", "stocks bars", f"""
SELECT symbol, sector, {rounded('market_cap avg_volume last_price')} FROM stocks JOIN (
 SELECT symbol, avg(volume) AS avg_volume, arg_max(close, date) AS last_price FROM
  (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS n FROM bars) WHERE n <= 63 GROUP BY symbol) USING (symbol)
WHERE market_cap > 5e9 AND avg_volume*last_price > {LIQUIDITY_FLOOR}""")(
    lambda v: screens.liquidity_gate(v.stocks, v.bars, 5e9, LIQUIDITY_FLOOR).select(
        "symbol", "sector", "market_cap", "avg_volume", "last_price"))
query("p12_wide_net", "signals", f"SELECT {DATE}, symbol, {rnd('entry_score')} AS entry_score FROM signals WHERE {D} AND (is_bullish OR entry_score > 60)")(
    lambda v: screens.wide_net(v.scored).select("date", "symbol", "entry_score"))
query("p13_liquid_days", "adjusted", f"SELECT isin, {DATE}, {rnd('adv_20')} AS adv_20 FROM adjusted WHERE adv_20 >= {LIQUIDITY_FLOOR}")(
    lambda v: v.adjusted.filter(F.col("adv_20") >= LIQUIDITY_FLOOR).select("isin", "date", "adv_20"))
STATUS = "CASE WHEN (close - ema21)/ema21*100 <= 3 THEN 'in_zone' WHEN (close - ema21)/ema21*100 <= 8 THEN 'extended' ELSE 'chasing' END"
ALERT_WHERE = f"{D} AND ema_signal IN ('bullish_cross', 'bullish_pullback') AND above_200ema"


def alert_sql(thr: float, consol: bool, tier1: bool = False) -> str:
    vol = "volume_breakout AND adx >= 30" if tier1 else "(volume_breakout OR adx >= 20)"
    return f"""SELECT date, symbol, sector, entry_score,
 CASE WHEN volume_breakout AND coalesce(adx, 0) >= 30 THEN 1 WHEN volume_breakout OR coalesce(adx, 0) >= 20 THEN 2 ELSE 3 END AS signal_tier,
 {STATUS} AS entry_status, (close - ema21)/ema21*100 AS pct_above_ema21
FROM signals JOIN stocks USING (symbol) WHERE {ALERT_WHERE} AND rsi BETWEEN 35 AND 65 AND momentum_12m > 0 AND entry_score >= {thr}
 AND {vol} {'AND is_consolidating' if consol else ''}"""


SENT = "SELECT DISTINCT symbol, date FROM trades JOIN (SELECT symbol AS s, date FROM bars) b ON b.s = symbol AND b.date = entry_date"
LOOSE = SignalConfig(score_threshold=30.0, require_consolidation=False)
CONFIGS = {"trend_initiation": SignalConfig(score_threshold=45.0), "trend_continuation": LOOSE}
query("p15_entry_alerts", "signals stocks", f"""
SELECT {DATE}, symbol, sector, signal_tier, entry_status, {rounded('entry_score pct_above_ema21')} FROM ({alert_sql(30, False)})
WHERE (symbol, date) NOT IN (SELECT l_suppkey, CAST(l_shipdate AS DATE) FROM lineitem WHERE l_returnflag = 'R')""")(
    lambda v: alerts.entry_alerts(v.scored, v.stocks, LOOSE, v.fills.filter("side = 'sell'").select(
        F.col("isin").alias("symbol"), "date").distinct()))
query("p16_entry_candidates", "signals", f"""
SELECT {DATE}, symbol, {rnd('CASE WHEN is_consolidating THEN entry_score ELSE entry_score*0.85 END')} AS score FROM signals
WHERE {D} AND bar >= 260 AND ema_signal IN ('bullish_cross', 'bullish_pullback', 'bullish') AND close > ema200 AND momentum_12m > 0
 AND adx >= 20 AND macd > macd_signal AND rsi BETWEEN 35 AND 65 AND entry_score > 0
 AND CASE WHEN is_consolidating THEN entry_score ELSE entry_score*0.85 END >= 30""")(
    lambda v: research.entry_candidates(v.scored, LOOSE))
query("p16_near_high_candidates", "signals", f"""
SELECT {DATE}, symbol, {rnd('CASE WHEN is_consolidating THEN entry_score ELSE entry_score*0.85 END')} AS score FROM signals
WHERE {D} AND bar >= 260 AND ema_signal IN ('bullish_cross', 'bullish_pullback', 'bullish') AND close > ema200 AND momentum_12m > 0
 AND adx >= 20 AND macd > macd_signal AND rsi BETWEEN 35 AND 65 AND entry_score > 0 AND (close/week52_high - 1)*100 >= -8
 AND CASE WHEN is_consolidating THEN entry_score ELSE entry_score*0.85 END >= 30""")(
    lambda v: research.entry_candidates(v.scored, LOOSE, max_pct_from_52w_high=-8.0))
query("p17_dashboard_facets", "signals stocks", f"""
SELECT symbol, sector, confluence_count FROM stocks JOIN (SELECT symbol, CAST(count(*) FILTER (WHERE is_bullish) AS BIGINT) AS confluence_count FROM signals s
 WHERE date = (SELECT max(date) FROM signals x WHERE x.timeframe = s.timeframe) GROUP BY symbol) USING (symbol)
WHERE sector IN ('ASIA', 'EUROPE', 'AFRICA') AND confluence_count >= 1""")(
    lambda v: v.stocks.join(dashboard.confluence_counts(v.scored), "symbol").filter(
        F.col("sector").isin("ASIA", "EUROPE", "AFRICA") & (F.col("confluence_count") >= 1)).select(
        "symbol", "sector", "confluence_count"))
query("p18_search_stocks", "stocks", """
SELECT symbol, name, sector, CASE WHEN CAST(symbol AS VARCHAR) = '1' THEN 0 WHEN starts_with(CAST(symbol AS VARCHAR), '1') THEN 1
 WHEN starts_with(lower(name), '1') THEN 2 ELSE 3 END AS kind FROM stocks
WHERE CAST(symbol AS VARCHAR) ILIKE '%1%' OR name ILIKE '%1%' ORDER BY kind, symbol LIMIT 15""")(
    lambda v: screens.search_stocks(v.stocks, "1"))
query("p19_market_cap_bucket", "stocks", """
SELECT symbol, CASE WHEN market_cap IS NULL OR market_cap = 0 THEN 'unknown' WHEN market_cap >= 2e11 THEN 'largecap'
 WHEN market_cap >= 5e10 THEN 'midcap' ELSE 'smallcap' END AS bucket FROM stocks""")(
    lambda v: v.stocks.select("symbol", screens.market_cap_bucket(F.col("market_cap")).alias("bucket")))
query("p20_entry_status", "signals", f"""
SELECT {DATE}, symbol, CASE WHEN ema21 IS NULL OR ema21 = 0 THEN 'unknown' ELSE {STATUS} END AS status FROM signals WHERE {D}""")(
    lambda v: v.scored.filter("timeframe = 'D'").select("date", "symbol", alerts.entry_status(F.col("close"), F.col("ema21")).alias("status")))
query("p21_action_centre", "journal last_bars", f"""
SELECT symbol, trade_id, kind, {rnd('dist_pct')} AS dist_pct FROM (
 SELECT symbol, trade_id, 'entry_candidate' AS kind, NULL AS dist_pct FROM journal JOIN last_bars b USING (symbol) WHERE close BETWEEN planned_entry_low AND planned_entry_high
 UNION ALL SELECT symbol, trade_id, 'sl_risk', (close - stop_loss)/stop_loss*100 FROM journal JOIN last_bars USING (symbol)
  WHERE status = 'open' AND (close - stop_loss)/stop_loss*100 <= 1
 UNION ALL SELECT symbol, trade_id, 'target_near', (target - close)/close*100 FROM journal JOIN last_bars USING (symbol)
  WHERE status = 'open' AND (target - close)/close*100 <= 1)""")(
    lambda v: alerts.action_centre(v.journal, v.journal, v.last_bars))
query("p22_exit_alerts", "journal last_bars", f"""
SELECT symbol, trade_id, alert_type, CASE WHEN alert_type LIKE '%_hit' THEN 'critical' WHEN alert_type = 'target_approached' THEN 'medium' ELSE 'high' END AS urgency,
 {rnd('unrealised_pct')} AS unrealised_pct, holding_days FROM (
 SELECT symbol, trade_id, CASE WHEN low <= stop_loss THEN 'stop_hit' WHEN (close - stop_loss)/entry_price*100 < 2 THEN 'stop_approached'
  WHEN high >= target THEN 'target_hit' WHEN (target - close)/entry_price*100 < 2 THEN 'target_approached'
  WHEN rsi > 80 AND close < prev_low THEN 'overextended_exit' END AS alert_type,
  (close - entry_price)/entry_price*100 AS unrealised_pct, date - entry_date AS holding_days
 FROM journal JOIN last_bars USING (symbol) WHERE status = 'open') WHERE alert_type IS NOT NULL""")(
    lambda v: alerts.exit_alerts(v.journal, v.last_bars).drop("date"))
DIGEST = {"trend_initiation": SignalConfig(score_threshold=45.0, consolidation_bars=10, consolidation_pct=9.0),
          "range_break": SignalConfig(score_threshold=20.0, consolidation_bars=30, consolidation_pct=25.0, min_adx=35.0),
          "trend_continuation": replace(LOOSE, min_adx=28.0)}
RANGE = "bar >= {0} AND lo{0} > 0 AND (hi{0} - lo{0})/lo{0}*100 <= {1}"
query("p23_signal_digest", "signals stocks", f"""
SELECT {DATE}, symbol, sector, {rnd('entry_score')} AS entry_score, CASE WHEN volume_breakout AND coalesce(adx, 0) >= CASE WHEN a THEN 20 WHEN b THEN 35 ELSE 28 END THEN 1 ELSE 2 END AS tier,
 array_to_string(list_filter(list_value(CASE WHEN a THEN 'trend_initiation' END, CASE WHEN b THEN 'range_break' END, CASE WHEN k THEN 'trend_continuation' END), lambda x: x IS NOT NULL), ',') AS strategy_tags
FROM (SELECT *, coalesce(entry_score >= 45 AND {RANGE.format(10, 9)}, false) AS a, coalesce(entry_score >= 20 AND {RANGE.format(30, 25)}, false) AS b, entry_score >= 30 AS k FROM (
 SELECT *, max(high) OVER x AS hi10, min(low) OVER x AS lo10, max(high) OVER y AS hi30, min(low) OVER y AS lo30 FROM signals WHERE {D}
 WINDOW x AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), y AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)))
JOIN stocks USING (symbol) WHERE {ALERT_WHERE} AND rsi BETWEEN 35 AND 65 AND (a OR b OR k)""")(
    lambda v: alerts.signal_digest(v.scored, v.stocks, DIGEST).withColumn("strategy_tags", F.array_join("strategy_tags", ",")))
query("p26_list_stocks", "stocks", "SELECT symbol, name, sector, industry FROM stocks WHERE sector = 'ASIA' ORDER BY symbol")(
    lambda v: screens.list_stocks(v.stocks, sector="ASIA").select("symbol", "name", "sector", "industry"))

CONF = f"""SELECT d.date, d.symbol, d.entry_score FROM signals d JOIN (
 SELECT c.date, w.date AS wd, m.date AS md FROM (SELECT DISTINCT date FROM signals WHERE {D}) c
 ASOF JOIN (SELECT DISTINCT date FROM signals WHERE timeframe = 'W') w ON c.date >= w.date
 ASOF JOIN (SELECT DISTINCT date FROM signals WHERE timeframe = 'M') m ON c.date >= m.date) k ON k.date = d.date
JOIN signals w ON w.symbol = d.symbol AND w.timeframe = 'W' AND w.date = k.wd AND w.is_bullish
JOIN signals m ON m.symbol = d.symbol AND m.timeframe = 'M' AND m.date = k.md AND m.is_bullish
WHERE d.timeframe = 'D' AND d.is_bullish AND d.above_200ema AND d.rsi >= 40 AND d.rsi < 75"""
query("j01_mtf_confluence", "signals", f"SELECT {DATE}, symbol, {rnd('entry_score')} AS score FROM ({CONF})")(
    lambda v: screens.mtf_confluence(v.scored, v.stocks))
ROT = f"""SELECT date, sector, avg(rs_score) AS avg_rs, avg(momentum_3m) AS avg_momentum_3m, avg(CAST(is_bullish AS INTEGER))*100 AS bullish_pct,
 count(symbol) AS stock_count FROM signals JOIN stocks USING (symbol) WHERE {D} AND rs_score IS NOT NULL GROUP BY date, sector HAVING count(symbol) >= 3"""
query("a02_sector_rotation", "signals stocks", f"SELECT {DATE}, sector, stock_count, {rounded('avg_rs avg_momentum_3m bullish_pct')} FROM ({ROT})")(
    lambda v: screens.sector_rotation(v.signals, v.stocks))
query("j02_hot_sectors", "signals stocks", f"""
SELECT {DATE}, sector, symbol, {rnd('entry_score')} AS score FROM signals JOIN stocks USING (symbol) WHERE {D} AND rs_score >= 60 AND above_200ema AND is_bullish
 AND (date, sector) IN (SELECT (date, sector) FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY round(avg_rs, 9) DESC, sector) AS n FROM ({ROT})) WHERE n <= 3)""")(
    lambda v: screens.hot_sectors(v.signals, v.stocks, screens.sector_rotation(v.signals, v.stocks)).drop("rs_score"))


def stored_screens(v):
    """All screens from stored signals, written to the results table and read from there."""
    stored = storage.scratch_path(v.spark, "signals")
    storage.write_partitions(v.signals.select(*screens.READ), stored, ["timeframe"])
    signals = v.spark.read.parquet(stored)
    path = storage.scratch_path(v.spark, "screens")
    days = signals.filter("timeframe = 'D'").select(F.col("date").alias("computed_at")).distinct()
    screens.store_results(screens.materialise_all(signals, v.stocks), days, path)
    return screens.stored_results(v.spark, path)


HOT = f"""(date, sector) IN (SELECT (date, sector) FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY round(avg_rs, 9) DESC, sector) AS n FROM ({ROT})) WHERE n <= 3)"""
query("s16_materialised_screens", "signals stocks", f"""
WITH r AS ({RESULTS} UNION ALL SELECT 'mtf_confluence', date, symbol, entry_score, row_number() OVER (PARTITION BY date ORDER BY entry_score DESC, symbol) FROM ({CONF})
 UNION ALL SELECT 'sector_leaders', date, symbol, rs_score, row_number() OVER (PARTITION BY date ORDER BY sector, rs_score DESC, symbol) FROM (
  SELECT date, sector, symbol, rs_score, rank() OVER (PARTITION BY date, sector ORDER BY rs_score DESC) AS k FROM signals JOIN stocks USING (symbol)
  WHERE {D} AND above_200ema AND is_bullish AND rs_score IS NOT NULL) WHERE k <= 3
 UNION ALL SELECT 'hot_sectors', date, symbol, entry_score, row_number() OVER (PARTITION BY date ORDER BY rs_score DESC, symbol) FROM signals JOIN stocks USING (symbol)
  WHERE {D} AND rs_score >= 60 AND above_200ema AND is_bullish AND {HOT})
SELECT screen_slug, CAST(computed_at AS VARCHAR) AS computed_at, symbol, {rnd('score')} AS score, rank FROM r""")(stored_screens)
query("j03_enriched_screen", "signals stocks", f"""
SELECT CAST(r.computed_at AS VARCHAR) AS computed_at, r.symbol, sector, rank, CAST(signal_date AS VARCHAR) AS signal_date, ema_signal, is_bullish, {rounded('r.score')}
 , {rnd('peg_ratio')} AS peg_ratio, {rnd('close')} AS close, {rnd('rsi')} AS rsi
FROM ({RESULTS}) r JOIN stocks USING (symbol) LEFT JOIN ({PEG}) p USING (symbol) LEFT JOIN (
 SELECT symbol, date AS signal_date, close, rsi, ema_signal, is_bullish FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS n FROM signals WHERE {D}) WHERE n = 1) USING (symbol)
WHERE screen_slug = 'volume_surge'""".replace("AS r.score", "AS score"))(
    lambda v: screens.enrich(screens.materialise(v.scored, v.stocks, ["volume_surge"]), v.scored, v.stocks, ratios(v)).select(
        "computed_at", "symbol", "sector", "rank", "signal_date", "ema_signal", "is_bullish", "score", "peg_ratio", "close", "rsi"))
query("j04_signals_in_screen", "signals", f"""
SELECT {DATE}, symbol, {rnd('entry_score')} AS entry_score FROM signals WHERE {D} AND {WHERE['near_52w_high']}""")(
    lambda v: screens.signals_of_screen(v.scored, v.stocks, "near_52w_high").select("date", "symbol", "entry_score"))
query("w11_sector_leaders", "signals stocks", f"""
SELECT * FROM (SELECT {DATE}, sector, symbol, rank() OVER (PARTITION BY date, sector ORDER BY rs_score DESC) AS sector_rank, {rnd('rs_score')} AS score
 FROM signals JOIN stocks USING (symbol) WHERE {D} AND above_200ema AND is_bullish AND rs_score IS NOT NULL) WHERE sector_rank <= 3""")(
    lambda v: screens.sector_leaders(v.signals, v.stocks))
CC = "SELECT symbol, CAST(count(*) FILTER (WHERE is_bullish) AS BIGINT) AS confluence_count FROM signals s WHERE date = (SELECT max(date) FROM signals x WHERE x.timeframe = s.timeframe) GROUP BY symbol"
query("a03_confluence_count", "signals", CC)(lambda v: dashboard.confluence_counts(v.scored_to_newest, v.newest_dates))
query("a04_daily_report", "signals stocks", f"""
SELECT {DATE}, symbol, name, confluence_count, place, {rounded('daily_score rsi')} FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY confluence_count DESC, daily_score DESC, symbol) AS place FROM (
 SELECT date, symbol, name, CAST(count(*) FILTER (WHERE is_bullish) AS BIGINT) AS confluence_count, max(CASE WHEN {D} THEN entry_score ELSE 0 END) AS daily_score,
 max(CASE WHEN {D} THEN rsi ELSE 0 END) AS rsi FROM signals JOIN stocks USING (symbol) GROUP BY date, symbol, name)) WHERE place <= 20""")(
    lambda v: dashboard.daily_report(v.scored, v.stocks))
for sort_by, order in (("confluence", "confluence_count DESC, coalesce(is_bullish, false) DESC, coalesce(entry_score, 0) DESC"),
                       ("score", "coalesce(entry_score, 0) DESC"), ("rsi", "coalesce(rsi, 0) DESC")):
    query(f"t01_result_page_{sort_by}", "signals stocks", f"""
SELECT symbol, sector, confluence_count, {rounded('entry_score rsi')}, total, total > 7 AS has_more FROM (SELECT s.*, confluence_count, is_bullish, entry_score, rsi, count(*) OVER () AS total
 FROM stocks s JOIN ({CC}) c USING (symbol) LEFT JOIN (SELECT symbol, is_bullish, entry_score, rsi FROM signals WHERE {D} AND date = (SELECT max(date) FROM signals WHERE {D})) d USING (symbol))
ORDER BY {order}, symbol OFFSET 2 LIMIT 5""".replace("{rounded", "{rounded"))(
        lambda v, sort_by=sort_by: dashboard.result_page(v.scored_to_newest, v.stocks, sort_by, offset=2, limit=5, newest=v.newest_dates))
CHG = f"""SELECT n.date, n.pd, n.symbol, CASE WHEN NOT coalesce(p.bull, false) AND coalesce(n.bull, false) THEN 'newly_bullish'
 WHEN coalesce(p.bull, false) AND NOT coalesce(n.bull, false) THEN 'turned_bearish' WHEN n.conf > p.conf THEN 'confluence_improved'
 WHEN n.conf < p.conf THEN 'confluence_dropped' END AS change_type, p.score AS prev_score, n.score AS curr_score, n.close AS close_price, n.chg AS price_change_pct
FROM now n JOIN pd p ON p.symbol = n.symbol AND p.date = n.pd"""
CHG_CTE = f"""pd AS MATERIALIZED (SELECT symbol, date, count(*) FILTER (WHERE is_bullish) AS conf, bool_or(is_bullish) FILTER (WHERE {D}) AS bull,
 max(entry_score) FILTER (WHERE {D}) AS score, max(close) FILTER (WHERE {D}) AS close, max(price_change_pct) FILTER (WHERE {D}) AS chg FROM signals GROUP BY 1, 2),
cal AS MATERIALIZED (SELECT date, lag(date) OVER (ORDER BY date) AS pd FROM (SELECT DISTINCT date FROM signals WHERE {D})),
now AS MATERIALIZED (SELECT pd.*, cal.pd FROM pd JOIN cal ON cal.date = pd.date WHERE cal.pd IS NOT NULL)"""
CHG_OUT = f"{DATE}, CAST(pd AS VARCHAR) AS prev_date, symbol, change_type, {rounded('prev_score curr_score close_price price_change_pct')}"
query("j24_signal_changes", "signals", f"WITH {CHG_CTE} SELECT {CHG_OUT} FROM ({CHG}) WHERE change_type IS NOT NULL")(
    lambda v: dashboard.signal_changes(v.scored))
query("t02_top_changes", "signals", f"""
WITH {CHG_CTE} SELECT {CHG_OUT} FROM (SELECT *, row_number() OVER (PARTITION BY date, change_type IN ('newly_bullish', 'confluence_improved')
 ORDER BY coalesce(curr_score, 0) DESC, symbol) AS n FROM ({CHG}) WHERE change_type IS NOT NULL) WHERE n <= 10""")(
    lambda v: dashboard.top_changes(dashboard.signal_changes(v.scored)))
query("t06_best_alert_per_symbol", "signals stocks", f"""
SELECT {DATE}, symbol, strategy_id, signal_tier, {rnd('entry_score')} AS entry_score FROM (SELECT *, row_number() OVER (PARTITION BY date, symbol ORDER BY signal_tier, entry_score DESC, strategy_id) AS n FROM (
 SELECT 'trend_continuation' AS strategy_id, * FROM ({alert_sql(30, False)}) UNION ALL SELECT 'trend_initiation', * FROM ({alert_sql(45, True)}))) WHERE n = 1""")(
    lambda v: alerts.best_alert_per_symbol(alerts.entry_alerts_of(v.scored, v.stocks, CONFIGS)).select(
        "date", "symbol", "strategy_id", "signal_tier", "entry_score"))
query("w42_day_change", "bars", f"SELECT symbol, {DATE}, {rnd('close')} AS close, {rnd('(close/lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1)*100')} AS price_change_pct FROM bars")(
    lambda v: dashboard.day_change(v.bars))
query("w45_latest_per_timeframe", "signals", f"""
SELECT symbol, timeframe, {DATE}, ema_signal, rsi_signal, {rounded('entry_score rsi adx rs_score')} FROM (SELECT *, row_number() OVER (PARTITION BY symbol, timeframe ORDER BY date DESC) AS n FROM signals) WHERE n = 1""")(
    lambda v: dashboard.latest_per_timeframe(v.signals))
query("w45_score_history", "signals", f"""
SELECT symbol, {DATE}, {rnd('entry_score')} AS entry_score FROM signals WHERE {D}""")(
    lambda v: dashboard.score_history(v.scored))
query("j28_watch_metrics", "journal last_bars panel", f"""
SELECT j.symbol, trade_id, b.bar - p.bar AS days_elapsed, {rnd('b.close')} AS current_price, {rnd('coalesce((b.close - b.ema21)/b.ema21*100, 0)')} AS vs_ema21_pct,
 b.close BETWEEN planned_entry_low AND planned_entry_high AS in_zone, CASE WHEN b.bar - p.bar > 8 THEN 'expired' ELSE 'watching' END AS status
FROM journal j JOIN last_bars b USING (symbol) JOIN panel p ON p.timeframe = 'D' AND p.symbol = j.symbol AND p.date = j.signal_date""")(
    lambda v: alerts.watch_metrics(v.journal, v.panel.filter("timeframe = 'D'").select("symbol", "date", F.col("_bar").alias("bar")), v.last_bars))
query("f09_trade_setup", "signals", f"""
WITH z AS (SELECT date, symbol, atr, CASE WHEN ema_signal = 'bullish_cross' THEN 'ema_crossover' WHEN ema_signal = 'bullish_pullback' THEN 'pullback_to_ema21'
  WHEN coalesce(pct_from_resistance BETWEEN -3 AND 0, false) THEN 'resistance_breakout' ELSE 'trend_continuation' END AS setup_type, close, ema21, resistance_level FROM signals WHERE {D} AND atr > 0),
y AS (SELECT *, CASE setup_type WHEN 'ema_crossover' THEN close*0.995::DOUBLE WHEN 'pullback_to_ema21' THEN ema21*0.99::DOUBLE WHEN 'resistance_breakout' THEN resistance_level*1.002::DOUBLE ELSE close*0.99::DOUBLE END AS lo,
 CASE setup_type WHEN 'ema_crossover' THEN close*1.005::DOUBLE WHEN 'pullback_to_ema21' THEN ema21*1.01::DOUBLE WHEN 'resistance_breakout' THEN resistance_level*1.01::DOUBLE ELSE close*1.01::DOUBLE END AS hi FROM z),
x AS (SELECT *, (lo + hi)/2 AS mid, greatest((lo + hi)/2 - 2.0*atr, (lo + hi)/2*(1 - 7.0::DOUBLE/100)) AS stop FROM y)
SELECT {DATE}, symbol, setup_type, CAST(floor(30000.0::DOUBLE/(mid - stop)) AS BIGINT) AS shares FROM x WHERE mid - stop > 0""")(
    lambda v: v.scored.filter("timeframe = 'D'").select("date", "symbol", alerts.trade_setup().alias("t")).filter("t IS NOT NULL").select(
        "date", "symbol", "t.setup_type", "t.shares"))
query("f29_score_breakdown", "signals", f"""
SELECT {DATE}, symbol, label, {rounded('earned maximum')} FROM (SELECT date, symbol, unnest([
 {{'label': 'ema200', 'earned': pts_ema200, 'maximum': 7.0::DOUBLE}}, {{'label': 'ema', 'earned': pts_ema, 'maximum': 28.5::DOUBLE}}, {{'label': 'macd', 'earned': pts_macd, 'maximum': 21.5::DOUBLE}},
 {{'label': 'rsi', 'earned': pts_rsi, 'maximum': 21.5::DOUBLE}}, {{'label': 'volume', 'earned': pts_volume, 'maximum': 21.5::DOUBLE}}, {{'label': 'trend', 'earned': pts_trend, 'maximum': 7.0::DOUBLE}}], recursive := true)
 FROM signals WHERE {D})""")(
    lambda v: research.score_breakdown(v.scored.filter("timeframe = 'D'")))


def unsent_exits(v):
    hits = alerts.exit_alerts(v.journal, v.last_bars)
    return alerts.unsent(hits, hits.filter("symbol % 3 = 0 AND alert_type = 'stop_hit'")).select("symbol", "date", "alert_type", "trade_id")


query("p22_unsent_exit_alerts", "journal last_bars", f"""
SELECT symbol, {DATE}, alert_type, min(trade_id) AS trade_id FROM (SELECT symbol, date, trade_id, CASE WHEN low <= stop_loss THEN 'stop_hit' WHEN (close - stop_loss)/entry_price*100 < 2 THEN 'stop_approached'
  WHEN high >= target THEN 'target_hit' WHEN (target - close)/entry_price*100 < 2 THEN 'target_approached' WHEN rsi > 80 AND close < prev_low THEN 'overextended_exit' END AS alert_type
 FROM journal JOIN last_bars USING (symbol) WHERE status = 'open') WHERE alert_type IS NOT NULL AND NOT (symbol % 3 = 0 AND alert_type = 'stop_hit') GROUP BY 1, 2, 3""")(unsent_exits)
