"""Registered queries: trades, fills, NAV metrics, validation statistics, live books."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.operators import books, calendar, factors, metrics, quality, regime, trades
from barloom.plans.oracle_views import cte, rnd, rounded
from barloom.plans.registry import query
from barloom.sources.views import LIQUIDITY_FLOOR

c = F.col
DATE = "CAST(date AS VARCHAR) AS date"
ND = NormalDist()

# --- trade statistics -----------------------------------------------------------
TM = """total_return_pct gross_return_pct avg_return_pct median_return_pct best_trade_pct worst_trade_pct avg_win_pct avg_loss_pct
win_rate total_cost_drag_pct expectancy profit_factor"""
query("a09_trade_metrics", "trades", f"""
SELECT total_trades, winning_trades, {rounded(TM)} FROM (SELECT *, wr*100 AS win_rate, gross_return_pct - total_return_pct AS total_cost_drag_pct, wr*avg_win_pct + (1 - wr)*avg_loss_pct AS expectancy FROM (
 SELECT count(*) AS total_trades, count(*) FILTER (WHERE r > 0) AS winning_trades, avg(r) AS avg_return_pct, median(r) AS median_return_pct, max(r) AS best_trade_pct, min(r) AS worst_trade_pct,
 sum(r/100*size)/1e6*100 AS total_return_pct, sum(return_pct/100*size)/1e6*100 AS gross_return_pct, avg(r) FILTER (WHERE r > 0) AS avg_win_pct, avg(r) FILTER (WHERE r <= 0) AS avg_loss_pct,
 count(*) FILTER (WHERE r > 0)*1.0::DOUBLE/count(*) AS wr, round(sum(r*size) FILTER (WHERE r > 0)/abs(sum(r*size) FILTER (WHERE r <= 0)), 4) AS profit_factor
 FROM (SELECT *, return_pct - 0.3::DOUBLE AS r FROM trades)))""")(lambda v: trades.trade_metrics(v.trades))
query("a09_adverse_excursion", "journal bars", f"""
SELECT trade_id, {rnd('least(coalesce(min(b.low)/any_value(j.entry_price)*100 - 100, 0), 0)')} AS mae_pct FROM journal j LEFT JOIN bars b ON b.symbol = j.symbol AND b.date BETWEEN j.entry_date AND j.exit_date GROUP BY trade_id""")(
    lambda v: trades.adverse_excursion(v.journal, v.bars).select("trade_id", "mae_pct"))
query("a09_exit_breakdown", "trades", "SELECT exit_reason, count(*) AS n FROM trades GROUP BY 1")(
    lambda v: trades.exit_breakdown(v.trades).select(F.explode("exit_breakdown").alias("exit_reason", "n")))
query("a22_grouped_stats", "trades", f"""
SELECT exit_reason, regime, sector, count(*) AS n, {rnd('avg(return_pct)')} AS mean, {rnd('median(return_pct)')} AS median, {rnd('stddev_samp(return_pct)')} AS std
FROM trades GROUP BY GROUPING SETS ((exit_reason), (regime), (sector))""")(lambda v: trades.grouped_stats(v.trades))
query("a23_year_month_returns", "trades", "SELECT year(exit_date) AS year, " + ", ".join(
    rnd(f"coalesce(sum(return_pct) FILTER (WHERE month(exit_date) = {i}), 0)") + f" AS m{i:02d}" for i in range(1, 13)) + " FROM trades GROUP BY 1")(
    lambda v: trades.year_month_returns(v.trades))
query("a24_regime_exit_matrix", "trades", """SELECT regime, count(*) FILTER (WHERE exit_reason = 'A') AS "A", count(*) FILTER (WHERE exit_reason = 'N') AS "N", count(*) FILTER (WHERE exit_reason = 'R') AS "R" FROM trades GROUP BY 1""")(
    lambda v: trades.regime_exit_matrix(v.trades, ["A", "N", "R"]))
SIDE = "(SELECT '{0}' AS side, trade_id, symbol, return_pct, size FROM trades ORDER BY return_pct {1}, trade_id, size, entry_date LIMIT 10)"
query("t05_best_and_worst", "trades", f"SELECT * FROM {SIDE.format('best', 'DESC')} UNION ALL SELECT * FROM {SIDE.format('worst', 'ASC')}")(
    lambda v: trades.best_and_worst(v.trades))
query("t03_trade_page", "trades", "SELECT trade_id, symbol, return_pct, size FROM trades WHERE exit_reason = 'R' ORDER BY return_pct DESC, trade_id, size, entry_date OFFSET 20 LIMIT 20")(
    lambda v: trades.trade_page(v.trades, "return_pct", exit_reason="R", page=2, page_size=20).select("trade_id", "symbol", "return_pct", "size"))
query("a27_gini", "trades", f"""
SELECT {rnd('sum((2*i - n - 1)*r)/(max(n)*max(n)*avg(r))')} AS gini FROM (SELECT size*return_pct AS r, row_number() OVER (ORDER BY size*return_pct) AS i, count(*) OVER () AS n FROM trades)""")(
    lambda v: trades.gini(v.trades.select((c("size") * c("return_pct")).alias("pnl")), "pnl"))
query("a28_top_k_share", "trades", f"SELECT {rnd('(SELECT sum(p) FROM (SELECT size*return_pct AS p FROM trades ORDER BY 1 DESC LIMIT 25))/sum(size*return_pct)')} AS share FROM trades")(
    lambda v: trades.top_k_share(v.trades.select((c("size") * c("return_pct")).alias("pnl")), "pnl", 25))
MAPPED = "(SELECT min(date) FROM idx WHERE date >= exit_date)"
query("j21_mapped_exits", "trades idx", "SELECT CAST(t.exit_date AS VARCHAR) AS exit_date, CAST(coalesce(i.date, (SELECT max(date) FROM idx)) AS VARCHAR) AS mapped FROM (SELECT DISTINCT exit_date FROM trades) t ASOF LEFT JOIN idx i ON t.exit_date <= i.date")(
    lambda v: trades.mapped_exits(v.trades, v.index))
cte("curve", "trades idx", """
SELECT *, max(equity) OVER (ORDER BY date) AS pk0 FROM (SELECT date, level, 1e6::DOUBLE + sum(coalesce(pnl, 0)) OVER (ORDER BY date) AS equity, level/first_value(level) OVER (ORDER BY date)*1000000 AS benchmark_equity FROM idx LEFT JOIN (
 SELECT mapped AS date, sum(p) AS pnl FROM (SELECT coalesce(i.date, (SELECT max(date) FROM idx)) AS mapped, p FROM (SELECT exit_date, sum((return_pct - 0.3::DOUBLE)/100*size) AS p FROM trades GROUP BY 1) t ASOF LEFT JOIN idx i ON t.exit_date <= i.date) GROUP BY 1) USING (date))""")
cte("curve2", "curve", """
SELECT date, equity, benchmark_equity, (pk - equity)/pk*100 AS drawdown_pct, sum(1 - hi) OVER (PARTITION BY run ORDER BY date) AS dd_days FROM (SELECT *, sum(hi) OVER (ORDER BY date) AS run FROM (
 SELECT *, CASE WHEN equity > coalesce(lag(pk) OVER (ORDER BY date), 1e6::DOUBLE) THEN 1 ELSE 0 END AS hi FROM (SELECT *, greatest(pk0, 1e6::DOUBLE) AS pk FROM curve)))""")
query("w44_equity_curve", "curve2", f"SELECT {DATE}, {rounded('equity benchmark_equity drawdown_pct')}, CAST(dd_days AS BIGINT) AS dd_days FROM curve2")(
    lambda v: trades.equity_curve(v.trades, v.index))
query("w44_curve_summary", "curve2", f"""
SELECT {rnd('max(drawdown_pct)')} AS max_drawdown_pct, CAST(max(dd_days) AS BIGINT) AS max_drawdown_duration, {rnd('avg(r)/stddev_pop(r)*sqrt(252)')} AS sharpe_ratio,
 {rnd('(arg_max(benchmark_equity, date)/arg_min(benchmark_equity, date) - 1)*100')} AS benchmark_return_pct FROM (SELECT *, CASE WHEN coalesce(lag(equity) OVER (ORDER BY date), 1e6::DOUBLE) > 0 THEN equity/coalesce(lag(equity) OVER (ORDER BY date), 1e6::DOUBLE) - 1 END AS r FROM curve2)""")(
    lambda v: trades.curve_summary(trades.equity_curve(v.trades, v.index)))

# --- concurrency -------------------------------------------------------------------
cte("conc", "trades", """
SELECT d.date, d.sector, CAST(sum(coalesce(n, 0)) OVER w AS BIGINT) AS active, sum(coalesce(cap, 0)) OVER w AS capital FROM (
 SELECT sector, CAST(unnest(generate_series(min(entry_date), max(exit_date), INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT 'ALL' AS sector, entry_date, exit_date FROM trades UNION ALL SELECT sector, entry_date, exit_date FROM trades) GROUP BY sector) d LEFT JOIN (
 SELECT sector, date, sum(n) AS n, sum(cap) AS cap FROM (SELECT sector, entry_date AS date, 1 AS n, size AS cap FROM trades UNION ALL SELECT sector, exit_date + 1, -1, -size FROM trades
  UNION ALL SELECT 'ALL', entry_date, 1, size FROM trades UNION ALL SELECT 'ALL', exit_date + 1, -1, -size FROM trades) GROUP BY 1, 2) e ON e.sector = d.sector AND e.date = d.date
WINDOW w AS (PARTITION BY d.sector ORDER BY d.date)""")
query("j17_daily_concurrency", "conc", f"SELECT {DATE}, active, round(capital, 2) AS capital FROM conc WHERE sector = 'ALL'")(
    lambda v: trades.daily_concurrency(v.trades).withColumn("capital", F.round("capital", 2)))
query("a42_concurrency_footprint", "conc trades", f"SELECT max(active) AS max_active, {rnd('quantile_cont(active, 0.95)')} AS p95, {rnd('quantile_cont(active, 0.99)')} AS p99, (SELECT count(DISTINCT symbol) FROM trades) AS names FROM conc WHERE sector = 'ALL'")(
    lambda v: trades.concurrency_footprint(v.trades))
query("a43_cap_breaches", "conc", f"""
SELECT {DATE}, sector AS scope, active, sector = 'ALL' AND capital > 1e7 AS over_capital, active > CASE WHEN sector = 'ALL' THEN 300 ELSE 70 END AS over_count FROM conc
WHERE (sector = 'ALL' AND capital > 1e7) OR active > CASE WHEN sector = 'ALL' THEN 300 ELSE 70 END""")(
    lambda v: trades.cap_breaches(v.trades, 1e7, 300, 70))

# --- fills ---------------------------------------------------------------------------
cte("pername", "fills", """
SELECT isin, coalesce(sum(qty*price) FILTER (WHERE side = 'buy'), 0) AS buy_notional, coalesce(sum(qty*price) FILTER (WHERE side <> 'buy'), 0) AS sell_notional, sum(cost) AS cost_paid,
 count(*) FILTER (WHERE side = 'buy') AS n_buys, count(*) FILTER (WHERE side <> 'buy') AS n_sells, max(date) FILTER (WHERE side <> 'buy') - min(date) FILTER (WHERE side = 'buy') AS hold_days FROM fills GROUP BY isin""")
query("a13_per_name_stats", "pername", f"SELECT isin, n_buys, n_sells, hold_days, n_sells > 0 AS is_closed, round(sell_notional - buy_notional - cost_paid, 2) AS realized_pnl, round(buy_notional, 2) AS buy_notional FROM pername")(
    lambda v: trades.per_name_stats(v.fills).select("isin", "n_buys", "n_sells", "hold_days", "is_closed", F.round("realized_pnl", 2).alias("realized_pnl"), F.round("buy_notional", 2).alias("buy_notional")))
query("a13_hit_rate", "pername", f"SELECT {rnd('avg(CASE WHEN sell_notional - buy_notional - cost_paid > 0 THEN 1.0 ELSE 0 END)')} AS hit_rate FROM pername WHERE n_sells > 0")(
    lambda v: trades.hit_rate(trades.per_name_stats(v.fills)))
cte("contrib", "fills", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY flow DESC, isin) AS place FROM (SELECT year(date) AS year, isin, sum(CASE WHEN side = 'buy' THEN -qty*price ELSE qty*price END - cost) AS flow FROM fills GROUP BY 1, 2)) WHERE place <= 10""")
query("a14_yearly_contributors", "contrib", "SELECT year, isin, place, round(flow, 2) AS flow FROM contrib")(
    lambda v: trades.yearly_contributors(v.fills).withColumn("flow", F.round("flow", 2)))
query("a37_contributor_rotation", "contrib", "SELECT count(DISTINCT isin) AS names, count(DISTINCT isin) >= 30 AS passed FROM contrib")(
    lambda v: trades.contributor_rotation(trades.yearly_contributors(v.fills), 30))
HOLD = "SELECT isin, min(date) FILTER (WHERE side = 'buy') AS s, coalesce(max(date) FILTER (WHERE side <> 'buy'), DATE '9999-12-31') AS e FROM fills GROUP BY isin"
query("j31_hold_windows", "fills", f"SELECT isin, CAST(s AS VARCHAR) AS start, CAST(e AS VARCHAR) AS end FROM ({HOLD}) WHERE s IS NOT NULL")(
    lambda v: trades.hold_windows(v.fills))
query("j27_held_gaps", "fills prices", f"""
SELECT h.isin, CAST(d.date AS VARCHAR) AS date FROM ({HOLD}) h JOIN (SELECT DISTINCT date FROM prices) d ON d.date BETWEEN s AND e WHERE (h.isin, d.date) NOT IN (SELECT (isin, date) FROM prices)""")(
    lambda v: trades.held_gaps(trades.hold_windows(v.fills), v.prices))
cte("trips", "fills", """
WITH x AS (SELECT *, lead({'s': side, 'd': date, 'n': qty*price, 'c': cost}) OVER (PARTITION BY isin ORDER BY date, fill_id, side, qty, price) AS nx FROM fills),
y AS (SELECT isin, date AS entry_date, fill_id, qty, price, nx.d AS exit_date, qty*price AS buy_notional, coalesce(nx.n, 0) AS sell_notional, cost + coalesce(nx.c, 0) AS cost, nx.d - date AS hold_days FROM x WHERE side = 'buy' AND (nx IS NULL OR nx.s <> 'buy')),
z AS (SELECT *, CASE WHEN exit_date IS NOT NULL THEN row_number() OVER (PARTITION BY isin, exit_date IS NULL ORDER BY entry_date, fill_id, qty, price) END AS k FROM y),
r AS (SELECT isin, reason, row_number() OVER (PARTITION BY isin ORDER BY date, fill_id, reason) AS k FROM fills WHERE side <> 'buy')
SELECT z.*, CASE WHEN exit_date IS NULL THEN 'still_open' ELSE coalesce(r.reason, 'unknown') END AS exit_reason FROM z LEFT JOIN r ON r.isin = z.isin AND r.k = z.k""")
trips = lambda v: trades.round_trips(v.fills, v.fills.filter("side <> 'buy'").select("isin", "date", "fill_id", "reason"))
query("w38_round_trips", "trips", "SELECT isin, CAST(entry_date AS VARCHAR) AS entry_date, CAST(exit_date AS VARCHAR) AS exit_date, hold_days, k, exit_reason, round(buy_notional, 2) AS buy_notional, round(sell_notional, 2) AS sell_notional FROM trips")(
    lambda v: trips(v).select("isin", "entry_date", "exit_date", "hold_days", "k", "exit_reason", F.round("buy_notional", 2).alias("buy_notional"), F.round("sell_notional", 2).alias("sell_notional")))
query("a29_trip_forensic", "trips", f"""
SELECT coalesce(exit_reason, 'ALL') AS exit_reason, count(*) AS n, {rnd('avg(CASE WHEN p > 0 THEN 100.0 ELSE 0 END)')} AS win_rate, round(avg(p), 3) AS expectancy, {rnd('avg(p) FILTER (WHERE p > 0)/abs(avg(p) FILTER (WHERE p <= 0))')} AS payoff,
 quantile_cont(hold_days, 0.25) AS hold_p25, quantile_cont(hold_days, 0.5) AS hold_p50, quantile_cont(hold_days, 0.75) AS hold_p75 FROM (SELECT *, sell_notional - buy_notional - cost AS p FROM trips WHERE exit_date IS NOT NULL) GROUP BY ROLLUP (exit_reason)""")(
    lambda v: trades.trip_forensic(trips(v)).withColumn("expectancy", F.round("expectancy", 3)))
cte("eod", "fills nav", """
WITH RECURSIVE f AS (SELECT f.*, qty*price/equity AS dw, row_number() OVER (PARTITION BY isin ORDER BY date, fill_id, side, qty, price) AS i FROM fills f JOIN nav USING (date)),
w AS (SELECT *, CASE side WHEN 'sell' THEN 0.0::DOUBLE WHEN 'buy' THEN qty ELSE 0.0::DOUBLE END AS h FROM f WHERE i = 1 UNION ALL
 SELECT f.*, CASE f.side WHEN 'sell' THEN 0.0::DOUBLE WHEN 'buy' THEN w.h + f.qty ELSE greatest(0, w.h - f.qty) END FROM w JOIN f ON f.isin = w.isin AND f.i = w.i + 1)
SELECT isin, date, arg_max(h, i) AS held_end, sum(dw) FILTER (WHERE side = 'buy') AS buy, sum(dw) FILTER (WHERE side = 'sell') AS sell, sum(dw) FILTER (WHERE side = 'trim') AS trim FROM w GROUP BY 1, 2""")
navfills = lambda v: v.fills.join(v.nav.select("date"), "date", "left_semi")
query("a16_holdings_by_day", "eod", f"SELECT isin, {DATE}, {rnd('coalesce(lag(held_end) OVER (PARTITION BY isin ORDER BY date), 0)')} AS held_start, {rnd('held_end')} AS held_end FROM eod")(
    lambda v: trades.end_of_day_holdings(navfills(v)))
cte("split", "eod", """
SELECT sum(CASE WHEN hs > 1e-9 THEN 0 ELSE coalesce(buy, 0) END) AS entry, sum(coalesce(sell, 0)) AS exit, sum(coalesce(trim, 0) + CASE WHEN hs > 1e-9 THEN coalesce(buy, 0) ELSE 0 END) AS reweight
FROM (SELECT *, coalesce(lag(held_end) OVER (PARTITION BY isin ORDER BY date), 0) AS hs FROM eod)""")
query("a16_turnover_split", "split", f"SELECT {rounded('entry exit reweight')}, {rnd('entry + exit + reweight')} AS total FROM split")(
    lambda v: trades.turnover_split(v.fills, v.nav))
query("a45_churn", "split", f"SELECT {rnd('(entry + exit)/(entry + exit + reweight)*5.81')} AS churn FROM split")(
    lambda v: trades.churn(trades.turnover_split(v.fills, v.nav), 5.81))
cte("anch", "prices", "SELECT max(date) AS date FROM prices GROUP BY date_trunc('month', date)")


def timeline_sql(where: str) -> str:
    return f"""SELECT a.date, m.isin FROM anch a JOIN (SELECT DISTINCT isin FROM fills) m ON true ASOF JOIN (
 SELECT isin, date AS d, arg_max(side, {{'f': fill_id, 's': side, 'q': qty, 'p': price}}) AS side FROM fills WHERE side <> 'trim' AND {where} GROUP BY 1, 2) f ON f.isin = m.isin AND a.date >= f.d WHERE f.side = 'buy'"""


anchs = lambda v: calendar.anchors(v.prices.select("date").distinct(), "monthly")
query("w54_holdings_timeline", "fills anch", f"SELECT isin, {DATE} FROM ({timeline_sql('true')})")(
    lambda v: trades.holdings_timeline(v.fills, anchs(v)))
query("a46_held_set_distance", "fills anch", f"""
SELECT {rnd('avg(d)')} AS mean_distance, count(*) AS dates FROM (SELECT date, avg(CASE WHEN n = 1 THEN 1.0 ELSE 0 END) AS d FROM (
 SELECT date, isin, count(*) AS n FROM ({timeline_sql('true')} UNION ALL {timeline_sql('qty > 10')}) GROUP BY 1, 2) GROUP BY date)""")(
    lambda v: trades.held_set_distance(trades.holdings_timeline(v.fills, anchs(v)), trades.holdings_timeline(v.fills.filter("qty > 10"), anchs(v))))
query("j18_matched_pairs", "trades", f"""
WITH a AS (SELECT DISTINCT symbol, entry_date FROM trades WHERE exit_reason = 'A'), b AS (SELECT DISTINCT symbol, entry_date FROM trades WHERE exit_reason = 'N')
SELECT (SELECT count(*) FROM a) AS trades, (SELECT count(*) FROM a JOIN b USING (symbol, entry_date)) AS matched, {rnd('(SELECT count(*) FROM a JOIN b USING (symbol, entry_date))*1.0/(SELECT count(*) FROM a)')} AS fraction""")(
    lambda v: trades.matched_pairs(*[v.trades.filter(c("exit_reason") == r).withColumnRenamed("symbol", "isin") for r in ("A", "N")]))
query("w43_spaced_screen_dates", "bars", f"""
WITH hits AS (SELECT symbol, date FROM bars WHERE volume > 30), kept AS (SELECT symbol, min(date) AS date FROM hits GROUP BY 1
UNION ALL SELECT symbol, d FROM (SELECT k.symbol, (SELECT min(h.date) FROM hits h WHERE h.symbol = k.symbol AND h.date >= k.date + 60) AS d FROM kept k) WHERE d IS NOT NULL)
SELECT symbol, {DATE} FROM kept""")(lambda v: trades.spaced_dates(v.bars.filter("volume > 30")))

# --- positions ---------------------------------------------------------------------------
query("j23_open_trades", "journal last_bars", f"""
SELECT symbol, trade_id, {rnd('close')} AS current_price, {rnd('(close - entry_price)*qty')} AS unrealised, {rnd('(close - entry_price)/entry_price*100')} AS unrealised_pct,
 {rnd('(close - stop_loss)/close*100')} AS to_stop_pct, {rnd('(target - close)/close*100')} AS to_target_pct FROM journal JOIN last_bars USING (symbol) WHERE status = 'open'""")(
    lambda v: trades.open_trades(v.journal, v.last_bars))
query("f34_closed_trades", "journal", f"SELECT symbol, trade_id, {rnd('(exit_price - entry_price)*qty')} AS pnl, {rnd('(exit_price - entry_price)/entry_price*100')} AS return_pct, exit_date - entry_date AS holding_days FROM journal WHERE status = 'closed'")(
    lambda v: trades.closed_trades(v.journal))
P = "(exit_price - entry_price)*qty"
OPEN = "SELECT {0} FROM journal JOIN last_bars USING (symbol) WHERE status = 'open'"
query("a20_journal_stats", "journal last_bars", f"""
SELECT count(*) AS closed, {rnd(f'avg(CASE WHEN {P} > 0 THEN 100.0 ELSE 0 END)')} AS win_rate, round(sum({P}), 3) AS total_pnl, {rnd('avg((exit_price - entry_price)/entry_price*100)')} AS avg_return_pct,
 ({OPEN.format('count(*)')}) AS open, round(({OPEN.format('sum((close - entry_price)*qty)')}), 3) AS open_unrealised FROM journal WHERE status = 'closed'""")(
    lambda v: trades.journal_stats(v.journal, v.last_bars).withColumns({k: F.round(k, 3) for k in ("total_pnl", "open_unrealised")}))
query("a21_book_summary", "journal last_bars", f"""
SELECT round(sum({P}), 3) AS realised, {rnd(f'sum({P}) FILTER (WHERE {P} > 0)/-sum({P}) FILTER (WHERE {P} < 0)')} AS profit_factor, {rnd('avg(exit_date - entry_date)')} AS avg_holding_days,
 round(({OPEN.format('sum((close - entry_price)*qty)')}), 3) AS unrealised FROM journal WHERE status = 'closed'""")(
    lambda v: trades.book_summary(v.journal, v.last_bars).withColumns({k: F.round(k, 3) for k in ("realised", "unrealised")}))
query("f10_position_size", "signals", f"SELECT symbol, {DATE}, {rnd('CASE WHEN atr > 0 THEN least(30000/(2*atr/close), 200000) ELSE 10000 END')} AS size FROM signals WHERE timeframe = 'D'")(
    lambda v: v.scored.filter("timeframe = 'D'").select("symbol", "date", trades.position_size(c("close"), c("atr")).alias("size")))
RESC = "SELECT isin, arg_min(adj_factor, date) AS f0, arg_max(adj_factor, date) AS f1, arg_min(close, date) AS basis, arg_max(close, date) AS close FROM adjusted GROUP BY isin"


def anchored(v):
    g = v.adjusted.groupBy("isin").agg(F.min_by("adj_factor", "date").alias("f0"), F.max_by("adj_factor", "date").alias("f1"),
                                       F.min_by("close", "date").alias("cost_basis"), F.max_by("close", "date").alias("close")).withColumn("shares", F.lit(10.0))
    basis, shares = trades.rescale_position(c("f0"), c("f1"))
    return g.select("isin", "close", basis.alias("new_basis"), shares.alias("new_shares"))


query("f27_rescaled_positions", "adjusted", f"SELECT isin, {rnd('basis*(f1/f0)')} AS new_basis, {rnd('10/(f1/f0)')} AS new_shares FROM ({RESC})")(
    lambda v: anchored(v).drop("close"))
query("f28_stop_breach", "adjusted", f"SELECT isin, close <= basis*(f1/f0)*(1 - 25.0::DOUBLE/100) AS breached FROM ({RESC})")(
    lambda v: anchored(v).select("isin", trades.stop_breached(c("close"), c("new_basis"), 25.0).alias("breached")))
query("q12_large_moves", "adjusted fills", f"""
SELECT isin, {DATE}, {rnd('move')} AS move, explained, coalesce(date BETWEEN s AND e, false) AS held FROM (SELECT isin, symbol, date, close_tr/lag(close_tr) OVER w - 1 AS move, coalesce(abs(adj_factor/lag(adj_factor) OVER w - 1) > 1e-6, false) AS explained
 FROM adjusted WINDOW w AS (PARTITION BY isin ORDER BY date)) a LEFT JOIN (SELECT isin AS hs, s, e FROM ({HOLD}) WHERE s IS NOT NULL) h ON h.hs = a.symbol WHERE abs(move) > 0.04""")(
    lambda v: trades.large_moves(v.adjusted, v.lifetimes.select("isin", "symbol").join(
        trades.hold_windows(v.fills).withColumnRenamed("isin", "symbol"), "symbol").select("isin", "start", "end"), 0.04))

# --- NAV metrics -------------------------------------------------------------------------
cte("navr", "nav", """SELECT date, equity, benchmark, equity/lag(equity) OVER (ORDER BY date) - 1 AS ret, benchmark/lag(benchmark) OVER (ORDER BY date) - 1 AS bret,
 equity/max(equity) OVER (ORDER BY date) - 1 AS dd, max(equity) OVER (ORDER BY date) AS peak, benchmark/max(benchmark) OVER (ORDER BY date) - 1 AS bdd FROM nav""")
CAGR = "pow(arg_max({0}, date)/arg_min({0}, date), 365.25/(max(date) - min(date))) - 1"
cte("navb", "nav", """SELECT date, equity, benchmark, equity/lag(equity) OVER (ORDER BY date) - 1 AS ret, benchmark/lag(benchmark) OVER (ORDER BY date) - 1 AS bret,
 equity/max(equity) OVER (ORDER BY date) - 1 AS dd, benchmark/max(benchmark) OVER (ORDER BY date) - 1 AS bdd FROM nav WHERE benchmark IS NOT NULL""")
NM = f"""SELECT count(*) AS days, min(date) AS start_date, max(date) AS end_date, {CAGR.format('equity')} AS cagr, stddev_samp(ret)*sqrt(252) AS annualized_vol, avg(ret)/stddev_samp(ret)*sqrt(252) AS sharpe,
 avg(ret)/stddev_samp(ret) FILTER (WHERE ret < 0)*sqrt(252) AS sortino, -min(dd) AS max_drawdown FROM navr"""
DDDAYS = "(SELECT t.date - (SELECT min(p.date) FROM navr p WHERE p.equity = t.peak) FROM (SELECT date, peak FROM navr ORDER BY dd, date LIMIT 1) t)"
query("a10_nav_metrics", "navr", f"SELECT days, CAST(start_date AS VARCHAR) AS start_date, CAST(end_date AS VARCHAR) AS end_date, {rounded('cagr annualized_vol sharpe sortino max_drawdown')}, {DDDAYS} AS dd_days, {rnd('cagr/max_drawdown')} AS calmar FROM ({NM})")(
    lambda v: metrics.nav_metrics(v.nav))
OVERLAY = """WITH b AS (SELECT date, coalesce(lag(fraction) OVER (ORDER BY date), 0.0) AS w, coalesce(level/lag(level) OVER (ORDER BY date), 1.0) AS r, CASE WHEN lag(level) OVER (ORDER BY date) IS NULL THEN 1.0 ELSE 1.0002::DOUBLE END AS g FROM idx JOIN debounced USING (date)),
n AS (SELECT *, coalesce(w <> lag(w) OVER (ORDER BY date), false) AS sw FROM b),
x AS (SELECT *, ln(CASE WHEN w = 1 THEN r ELSE g END) + CASE WHEN sw THEN ln(1 - 0.001::DOUBLE) ELSE 0 END AS step FROM n),
o AS (SELECT date, w, sw, exp(sum(step) OVER (ORDER BY date)) AS equity FROM x),
e AS (SELECT *, equity/lag(equity) OVER (ORDER BY date) - 1 AS ret, max(equity) OVER (ORDER BY date) AS peak, equity/max(equity) OVER (ORDER BY date) - 1 AS dd FROM o)"""
query("a12_overlay_metrics", "debounced idx", f"""
{OVERLAY}, m AS (SELECT {CAGR.format('equity')} AS cagr, -min(dd) AS max_dd, avg(ret)/stddev_samp(ret)*sqrt(252) AS sharpe, avg(w) AS f, count(*) FILTER (WHERE sw) AS k FROM e),
t AS (SELECT date, peak FROM e ORDER BY round(dd, 12), date LIMIT 1)
SELECT {rounded('cagr max_dd sharpe')}, {rnd('cagr/max_dd')} AS calmar, (SELECT t.date - (SELECT min(p.date) FROM e p WHERE p.equity >= t.peak - 1e-12) FROM t) AS max_dd_days, {rnd('f')} AS realized_avg_fraction, k AS n_rebalances FROM m""")(
    lambda v: metrics.overlay_metrics(regime.sleeve_nav(regime.debounced_fraction(v.index), v.index, 0.0002, 0.001)))
query("a10_exposure", "idx", f"SELECT {rnd('avg(x)')} AS avg_exposure, {rnd('median(x)')} AS median_exposure, {rnd('avg(CASE WHEN x < 1 THEN 1.0 ELSE 0 END)')} AS time_in_cash_pct FROM (SELECT level/100 AS x FROM idx)")(
    lambda v: metrics.exposure_stats(v.index.select((c("level") / 100).alias("exposure"))))
query("a11_relative_metrics", "navb", f"""
SELECT n_overlap, {rounded('information_ratio up_capture down_capture correlation beta')}, {rnd('sc')} AS strategy_cagr, {rnd('bc')} AS benchmark_cagr, {rnd('sd')} AS strategy_max_drawdown, {rnd('bd')} AS benchmark_max_drawdown,
 {rnd('sc/sd')} AS strategy_calmar, {rnd('bc/bd')} AS benchmark_calmar, {rnd('sc - bc')} AS excess_cagr, {rnd('(sc/sd)/(bc/bd)')} AS calmar_ratio, {rnd('sd/bd')} AS max_dd_ratio FROM (
 SELECT count(*) AS n_overlap, avg(ret - bret)/stddev_samp(ret - bret)*sqrt(252) AS information_ratio, avg(ret) FILTER (WHERE bret > 0)/avg(bret) FILTER (WHERE bret > 0) AS up_capture,
 avg(ret) FILTER (WHERE bret < 0)/avg(bret) FILTER (WHERE bret < 0) AS down_capture, corr(ret, bret) AS correlation, covar_samp(ret, bret)/var_samp(bret) AS beta,
 {CAGR.format('equity')} AS sc, {CAGR.format('benchmark')} AS bc, -min(dd) AS sd, -min(bdd) AS bd FROM navb)""")(lambda v: metrics.relative_metrics(v.nav.filter("benchmark IS NOT NULL")))
query("p25_go_decision", "navr navb", f"""
WITH m AS (SELECT ({CAGR.format('equity')})/-min(dd) AS s, (SELECT ({CAGR.format('benchmark')})/-min(bdd) FROM navb) AS b FROM navr)
SELECT {rnd('s')} AS c_strat, {rnd('b')} AS c_primary, {rnd('b*0.5')} AS c_floor, CASE WHEN s < b*0.5 THEN 'NO-GO' WHEN s >= 0.8*b THEN 'GO' ELSE 'GO (marginal)' END AS decision FROM m""")(
    lambda v: metrics.decision(metrics.nav_metrics(v.nav).select(c("calmar").alias("c_strat")).withColumn(
        "c_primary", metrics.nav_metrics(v.nav, "benchmark").select("calmar").scalar()).withColumn("c_floor", c("c_primary") * 0.5)))
query("w33_max_drawdown", "navr", f"SELECT {rnd('-min(dd)')} AS max_drawdown, {DDDAYS} AS dd_days FROM navr")(lambda v: metrics.max_drawdown(v.nav))
query("w34_underwater", "navr", f"SELECT {DATE}, {rnd('dd')} AS drawdown, {rnd('bdd')} AS index_drawdown FROM navr")(
    lambda v: metrics.underwater(v.nav).join(metrics.underwater(v.nav, "benchmark").select("date", c("drawdown").alias("index_drawdown")), "date").select("date", "drawdown", "index_drawdown"))
cte("epis", "nav", """
SELECT peak_date, trough_date, coalesce(nx, last_date) AS end_date, low/top - 1 AS depth FROM (SELECT *, lead(peak_date) OVER (ORDER BY isle) AS nx FROM (
 SELECT isle, min(date) AS peak_date, max(equity) AS top, min(equity) AS low, arg_min(date, {'v': equity, 'd': date}) AS trough_date, max(date) AS last_date FROM (
 SELECT *, sum(CASE WHEN equity >= pk THEN 1 ELSE 0 END) OVER (ORDER BY date) AS isle FROM (SELECT date, equity, max(equity) OVER (ORDER BY date) AS pk FROM nav)) GROUP BY isle)) WHERE 1 - low/top >= 0.002""")
query("w35_drawdown_episodes", "epis", f"SELECT CAST(peak_date AS VARCHAR) AS peak_date, CAST(trough_date AS VARCHAR) AS trough_date, CAST(end_date AS VARCHAR) AS end_date, {rnd('depth')} AS depth FROM epis")(
    lambda v: metrics.drawdown_episodes(v.nav, min_depth=0.002))
query("w36_episode_edges", "epis nav", f"""
SELECT CAST(peak_date AS VARCHAR) AS peak_date, CAST(end_date AS VARCHAR) AS end_date, {rnd('ln(b.equity/a.equity) - ln(b.benchmark/a.benchmark)')} AS edge FROM epis JOIN nav a ON a.date = peak_date JOIN nav b ON b.date = end_date""")(
    lambda v: metrics.episode_edges(metrics.drawdown_episodes(v.nav, min_depth=0.002), v.nav, "equity", "benchmark"))
query("w37_cumulative_excess", "nav", f"SELECT {DATE}, {rnd('equity/first_value(equity) OVER (ORDER BY date) - benchmark/first_value(benchmark) OVER (ORDER BY date)')} AS excess FROM nav WHERE benchmark IS NOT NULL UNION ALL SELECT CAST(date AS VARCHAR), NULL FROM nav WHERE benchmark IS NULL")(
    lambda v: metrics.cumulative_excess(v.nav))
query("w46_rebased_nav", "nav", f"""
SELECT {DATE}, {rnd('equity')} AS equity, {rnd('benchmark/(SELECT arg_min(benchmark, date) FROM nav WHERE benchmark IS NOT NULL)*(SELECT arg_min(equity, date) FROM nav WHERE benchmark IS NOT NULL)')} AS index_nav FROM nav""")(
    lambda v: metrics.rebased(v.nav).select("date", "equity", "index_nav"))
query("a19_tracking_error", "navr", f"SELECT {DATE}, {rnd('ret - bret')} AS diff, {rnd('sum(ret - bret) OVER (ORDER BY date)')} AS cumulative, {rnd('(SELECT stddev_samp(ret - bret)*sqrt(252) FROM navr)')} AS tracking_error FROM navr")(
    lambda v: metrics.tracking_error(v.nav))
query("f26_annual_drag", "idx", f"SELECT {DATE}, {rnd('level*pow(1 - 0.01::DOUBLE, (date - (SELECT min(date) FROM idx))/365.25)')} AS level FROM idx")(
    lambda v: metrics.annual_drag(v.index, 0.01))
query("a15_annualised_turnover", "fills", f"""
SELECT {rnd('sum(t)/((max(date) - min(date))/365.25)*100')} AS annualized_pct, sum(t)/((max(date) - min(date))/365.25)*100 > 1000 AS absurd FROM (SELECT last_day(date) AS date, sum(qty*price)/1e9 AS t FROM fills GROUP BY 1)""")(
    lambda v: metrics.annualised_turnover(v.fills.groupBy(F.last_day("date").alias("date")).agg((F.sum(c("qty") * c("price")) / 1e9).alias("turnover"))))
query("a36_capacity", "fills", f"SELECT isin, {rnd('avg(qty*price)/5e7*100')} AS capacity_pct FROM fills GROUP BY isin")(
    lambda v: v.fills.groupBy("isin").agg(F.avg(c("qty") * c("price")).alias("t")).select("isin", metrics.capacity(c("t"), 5e7).alias("capacity_pct")))
PERIODS = "SELECT CAST(year(date) AS VARCHAR) AS name, min(date) AS s, max(date) AS e FROM nav GROUP BY 1"
cte("percal", "nav", f"""
SELECT name, ({CAGR.format('equity')})/-min(dd) AS calmar FROM (SELECT CAST(year(date) AS VARCHAR) AS name, date, equity, equity/max(equity) OVER (PARTITION BY year(date) ORDER BY date) - 1 AS dd FROM nav) GROUP BY name HAVING min(dd) < 0""")
periods = lambda v: v.nav.groupBy(F.year("date").cast("string").alias("name")).agg(F.min("date").alias("start"), F.max("date").alias("end"))
query("a50_period_metrics", "percal", f"SELECT name, {rnd('calmar')} AS calmar FROM percal")(
    lambda v: metrics.period_metrics(v.nav, periods(v)).select("name", "calmar").filter("calmar IS NOT NULL"))
query("a50_concentration_rule", "percal", "SELECT NOT bool_or(coalesce(calmar > 5*((SELECT sum(calmar) FROM percal WHERE calmar > 0) - calmar)/nullif((SELECT count(*) FROM percal WHERE calmar > 0) - 1, 0), false)) AS passed, count(*) AS positive_periods FROM percal WHERE calmar > 0")(
    lambda v: metrics.concentration_rule(metrics.period_metrics(v.nav, periods(v))))

# --- validation statistics -----------------------------------------------------------------
cte("cfgret", "trades", "SELECT trade_id % 12 AS config, entry_date AS date, avg(return_pct)/1000 AS ret FROM trades GROUP BY 1, 2")
cfgret = lambda v: v.trades.groupBy((c("trade_id") % 12).alias("config"), c("entry_date").alias("date")).agg((F.avg("return_pct") / 1000).alias("ret"))
query("a49_fold_calmars", "cfgret", f"""
WITH x AS (SELECT *, row_number() OVER (PARTITION BY config ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY config) AS n FROM cfgret),
y AS (SELECT *, (SELECT count(*) FROM range(1, 6) t(k) WHERE floor(k*n/6) <= i) AS fold FROM x),
z AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY config, fold ORDER BY date)) AS eq FROM y),
u AS (SELECT *, eq/max(eq) OVER (PARTITION BY config, fold ORDER BY date) - 1 AS dd FROM z)
SELECT config, fold, {rnd('CASE WHEN count(*) >= 2 AND min(dd) < 0 THEN (pow(arg_max(eq, date), 252.0/count(*)) - 1)/-min(dd) ELSE 0 END')} AS calmar FROM u GROUP BY 1, 2""")(
    lambda v: metrics.fold_calmars(cfgret(v), 6))
cte("folds", "trades", """SELECT trade_id % 12 AS config, year(entry_date) AS fold, avg(return_pct)/stddev_samp(return_pct) AS sharpe, avg(return_pct)/10 AS calmar, CASE WHEN year(entry_date) = 1997 THEN 2.0 ELSE 1.0 END AS weight
FROM trades GROUP BY 1, 2""")
folds = lambda v: v.trades.groupBy((c("trade_id") % 12).alias("config"), F.year("entry_date").alias("fold")).agg(
    (F.avg("return_pct") / F.stddev_samp("return_pct")).alias("sharpe"), (F.avg("return_pct") / 10).alias("calmar")).withColumn("weight", F.when(c("fold") == 1997, 2.0).otherwise(1.0))
ROB = "SELECT config, (sum(weight*sharpe)/sum(weight) - stddev_pop(sharpe))*0.7::DOUBLE + sum(weight*calmar)/sum(weight)*0.3::DOUBLE AS robustness FROM folds GROUP BY config"
query("a33_fold_robustness", "folds", f"SELECT config, {rnd('robustness')} AS robustness FROM ({ROB})")(lambda v: metrics.robustness(folds(v)))
query("t04_top_configs", "folds", f"SELECT config, {rnd('robustness')} AS robustness FROM ({ROB}) ORDER BY robustness DESC, config LIMIT 5")(
    lambda v: metrics.top_configs(metrics.robustness(folds(v)), 5))
Z = (1 - metrics.EULER) * ND.inv_cdf(1 - 1 / 12) + metrics.EULER * ND.inv_cdf(1 - 1 / (12 * 2.718281828459045))
query("a34_deflated_sharpe", "cfgret", f"""
WITH m AS (SELECT config, avg(ret) AS mu, stddev_samp(ret) AS sd, count(*) AS n FROM cfgret GROUP BY 1),
k AS (SELECT config, any_value(mu/sd) AS sr, any_value(n) AS n, avg(pow((ret - mu)/sd, 3)) AS sk, avg(pow((ret - mu)/sd, 4)) - 3 AS ku FROM cfgret JOIN m USING (config) GROUP BY 1)
SELECT config, {rnd('sr*sqrt(252)')} AS sharpe, {rnd(f'(sr - {Z!r}::DOUBLE*sqrt(greatest((1 - sk*sr + ku/4*sr*sr)/(n - 1), 1e-12)))*sqrt(252)')} AS deflated_sharpe FROM k""")(
    lambda v: metrics.deflated_sharpe(cfgret(v), 12))
YEARS = tuple(range(1995, 2002))
query("a35_overfit_probability", "folds", f"""
WITH s AS (SELECT b FROM range(0, 128) t(b) WHERE bit_count(b) = 3), p AS (SELECT b, config, avg(sharpe) FILTER (WHERE (b >> (fold - 1995)::INTEGER) & 1 = 1) AS i, avg(sharpe) FILTER (WHERE (b >> (fold - 1995)::INTEGER) & 1 = 0) AS o FROM s, folds GROUP BY 1, 2),
w AS (SELECT b, arg_max(o, {{'i': i, 'c': -config}}) AS o FROM p GROUP BY b), g AS (SELECT p.b, avg(CASE WHEN p.o < w.o THEN 1.0 ELSE 0 END) AS om FROM p JOIN w USING (b) GROUP BY p.b)
SELECT {rnd('avg(CASE WHEN om < 0.5 THEN 1.0 ELSE 0 END)')} AS pbo, count(*) AS splits FROM g""")(
    lambda v: metrics.overfit_probability(folds(v).select("config", "fold", c("sharpe").alias("metric")), YEARS))
cte("points", "trades", "SELECT holding_days % 4 AS a, month(entry_date) % 3 AS b, avg(return_pct) AS calmar FROM trades GROUP BY 1, 2")
points = lambda v: v.trades.groupBy((c("holding_days") % 4).alias("a"), (F.month("entry_date") % 3).alias("b")).agg(F.avg("return_pct").alias("calmar"))
query("w48_plateau", "points", f"""
WITH w AS (SELECT * FROM points ORDER BY calmar DESC, a DESC, b DESC LIMIT 1)
SELECT {rnd('min(p.calmar)')} AS min_neighbour, count(*) AS neighbours, {rnd('any_value(w.calmar)')} AS winner, any_value(w.calmar) > 0 AND min(p.calmar) >= 0.85*any_value(w.calmar) AS has_plateau FROM points p, w WHERE abs(p.a - w.a) + abs(p.b - w.b) = 1""")(
    lambda v: metrics.plateau(points(v), ["a", "b"]))
query("u08_parameter_grid", "points", "SELECT a, b, r AS rsi_max, s AS stop FROM points, (SELECT unnest([60.0, 65.0, 70.0]) AS r), (SELECT unnest([5.0, 7.0]) AS s)")(
    lambda v: metrics.parameter_grid({"rsi_max": [60.0, 65.0, 70.0], "stop": [5.0, 7.0]}, points(v).select("a", "b")))
query("f33_walk_forward_folds", "nav", """
SELECT CAST(a AS VARCHAR) AS is_start, CAST(o - 1 AS VARCHAR) AS is_end, CAST(o AS VARCHAR) AS oos_start, CAST(CAST(o + INTERVAL 6 MONTH AS DATE) - 1 AS VARCHAR) AS oos_end FROM (
 SELECT a, z, CAST(a + to_months(CAST(24 + 6*k AS INTEGER)) AS DATE) AS o FROM (SELECT min(date) AS a, max(date) AS z FROM nav), range(0, 40) t(k)) WHERE CAST(o + INTERVAL 6 MONTH AS DATE) - 1 <= z""")(
    lambda v: v.nav.agg(F.min("date").alias("a"), F.max("date").alias("z")).select(F.inline(calendar.walk_forward(c("a"), c("z")))))
pick = lambda j: f"CAST('0x' || substr(md5('7|' || CAST(draw AS VARCHAR) || '|' || CAST({j} AS VARCHAR)), 1, 15) AS BIGINT) % ({j})"
query("a38_subset_retention", "pername", f"""
WITH p AS (SELECT isin, sell_notional - buy_notional - cost_paid AS pnl FROM pername), t AS (SELECT sum(pnl) AS t FROM p),
q AS (SELECT pnl, row_number() OVER (ORDER BY md5(CAST(isin AS VARCHAR)), isin) AS k, count(*) OVER () AS n FROM p),
d AS (SELECT draw, n, 1 + {pick('n - 2')} AS a, 1 + {pick('n - 1')} AS b, 1 + {pick('n')} AS c FROM (SELECT DISTINCT n FROM q), range(1, 51) r(draw)),
e AS (SELECT draw, n, a, CASE WHEN b = a THEN n - 1 ELSE b END AS b, c FROM d),
h AS (SELECT draw, unnest([a, b, CASE WHEN c IN (a, b) THEN n ELSE c END]) AS k FROM e),
g AS (SELECT draw, sum(pnl) AS lost FROM h JOIN q USING (k) GROUP BY draw)
SELECT count(*) AS draws, {rnd('quantile_cont((t - lost)/t, 0.5)')} AS median, {rnd('quantile_cont((t - lost)/t, 0.05)')} AS p5 FROM g, t""")(
    lambda v: metrics.subset_retention(trades.per_name_stats(v.fills).select("isin", c("realized_pnl").alias("pnl")), 50, 3, 7))

# --- live book -----------------------------------------------------------------------------
cte("bfills", "fills", """
SELECT isin, side, qty, price AS fill_price, price*(1 - (CAST(qty AS INTEGER) % 5)*0.001::DOUBLE) AS decision_price, cost, date, last_day(date) AS decision_date,
 CASE WHEN CAST(qty AS INTEGER) % 10 < 7 THEN 'rebalance' WHEN CAST(qty AS INTEGER) % 10 < 9 THEN 'catastrophic_stop' ELSE 'force_exit' END AS reason FROM fills""")


def bfills(v):
    q = c("qty").cast("int")
    return v.fills.select("isin", "side", "qty", c("price").alias("fill_price"), (c("price") * (1 - (q % 5) * F.lit(0.001))).alias("decision_price"), "cost", "date",
                          F.last_day("date").alias("decision_date"), F.when(q % 10 < 7, "rebalance").when(q % 10 < 9, "catastrophic_stop").otherwise("force_exit").alias("reason"))


def fc(side: str, q: str, p: str) -> str:
    return f"({q}*{p}*0.001::DOUBLE + {q}*{p}*(0.0000297::DOUBLE + 0.000001::DOUBLE)*1.18::DOUBLE + CASE WHEN {side} = 'buy' THEN {q}*{p}*0.00015::DOUBLE ELSE 15.34::DOUBLE END)"


def mc(slip: str) -> str:
    return f"({fc('side', 'qty', 'fill_price')} + fill_price*{slip}::DOUBLE*qty)"


WITH_ADV = "fills f JOIN prices p USING (isin, date)"
fadv = lambda v: v.fills.join(v.prices.select("isin", "date", "adv_20"), ["isin", "date"])
query("f11_fill_cost", "fills", f"SELECT isin, fill_id, side, {rnd(fc('side', 'qty', 'price'))} AS charge FROM fills")(
    lambda v: v.fills.select("isin", "fill_id", "side", books.fill_cost(c("side"), c("qty"), c("price")).alias("charge")))
SLIP = "(0.0015::DOUBLE + 0.15::DOUBLE*least(f.qty*f.price/adv_20, 0.1::DOUBLE))"
query("f12_effective_price", "fills prices", f"SELECT isin, fill_id, side, {rnd(f'f.price*CASE WHEN side = {chr(39)}buy{chr(39)} THEN 1 + {SLIP} ELSE 1 - {SLIP} END')} AS price FROM {WITH_ADV}")(
    lambda v: fadv(v).select("isin", "fill_id", "side", books.effective_price(c("side"), c("price"), c("qty"), c("adv_20")).alias("price")))
query("f31_modelled_cost", "bfills", f"SELECT isin, side, {DATE}, round({mc('0.003')}, 3) AS modelled FROM bfills")(
    lambda v: bfills(v).select("isin", "side", "date", books.modelled_cost(c("side"), c("qty"), c("fill_price"), books.CostConfig.pessimistic()).alias("modelled")).withColumn("modelled", F.round("modelled", 3)))
HEAD = "CASE WHEN bool_or(reason = 'rebalance') THEN 'rebalance' WHEN bool_or(reason = 'catastrophic_stop') THEN 'catastrophic_stop' ELSE 'force_exit' END"
cte("ledger", "bfills", f"""
SELECT decision_date, {HEAD} AS reason, sum(qty*fill_price) AS notional, sum(cost + abs(fill_price - decision_price)*qty) AS realized_cost, sum({mc('0.0015')}) AS base, sum({mc('0.003')}) AS pess FROM bfills GROUP BY ROLLUP (decision_date)""")
query("a17_cost_ledger", "ledger", f"""
SELECT CAST(decision_date AS VARCHAR) AS decision_date, reason, round(notional, 1) AS notional, round(realized_cost, 2) AS realized_cost, {rnd('realized_cost/notional*10000')} AS realized_bps, {rnd('base/notional*10000')} AS base_bps,
 {rnd('pess/notional*10000')} AS pess_bps, realized_cost <= pess AS within_band FROM ledger""")(
    lambda v: books.cost_ledger(bfills(v)).withColumns({"notional": F.round("notional", 1), "realized_cost": F.round("realized_cost", 2)}))
query("a25_rebalance_events", "bfills", f"""
SELECT CAST(decision_date AS VARCHAR) AS decision_date, {HEAD} AS reason, count(*) FILTER (WHERE side = 'buy') AS n_buys, count(*) FILTER (WHERE side = 'sell') AS n_sells, count(*) FILTER (WHERE side = 'trim') AS n_trims, round(sum(cost), 2) AS total_cost FROM bfills GROUP BY decision_date""")(
    lambda v: books.rebalance_events(bfills(v)).withColumn("total_cost", F.round("total_cost", 2)))
query("a25_event_fills", "bfills", f"SELECT isin, side, {DATE}, round(qty, 2) AS qty, r AS event_reason FROM bfills JOIN (SELECT decision_date, {HEAD} AS r FROM bfills GROUP BY 1) USING (decision_date)")(
    lambda v: books.event_fills(bfills(v)).select("isin", "side", "date", "qty", "event_reason"))
query("a18_live_turnover", "bfills nav", f"""
SELECT n_days, {rnd('t/a*(252.0/n_days)*100')} AS live_annualized_pct, {rnd('t/a*(252.0/n_days)*100/581')} AS ratio FROM (SELECT count(*) AS n_days, avg(equity) AS a, (SELECT sum(qty*fill_price) FROM bfills) AS t FROM nav)""")(
    lambda v: books.live_turnover(bfills(v), v.nav))
query("w49_cost_path", "ledger", f"""
SELECT CAST(decision_date AS VARCHAR) AS decision_date, round(sum(realized_cost) OVER w, 1) AS cumulative_cost, {rnd('sum(notional) OVER w/(count(*) OVER w*1e6)')} AS turnover_multiple FROM ledger WHERE decision_date IS NOT NULL WINDOW w AS (ORDER BY decision_date)""")(
    lambda v: books.cost_path(books.cost_ledger(bfills(v)).filter("decision_date IS NOT NULL").withColumnRenamed("realized_cost", "total_cost"), 1e6).withColumn("cumulative_cost", F.round("cumulative_cost", 1)))
query("a47_execution_cost", "fills prices", f"""
SELECT round(s, 1) AS statutory, round(l, 1) AS slippage, round(n, 1) AS notional, {rnd('(s + l)/n*10000')} AS total_bps FROM (SELECT sum(cost) AS s, sum(abs(f.price - open)*qty) AS l, sum(qty*f.price) AS n FROM {WITH_ADV})""")(
    lambda v: books.execution_cost(v.fills, v.prices).withColumns({k: F.round(k, 1) for k in ("statutory", "slippage", "notional")}))
cte("mv", "fills", "SELECT isin, sum(qty*price) FILTER (WHERE side = 'buy') AS mv, sum(qty*price) FILTER (WHERE side = 'sell') AS mv2 FROM fills GROUP BY isin")
mv = lambda v, s: v.fills.filter(c("side") == s).groupBy("isin").agg(F.sum(c("qty") * c("price")).alias("mv"))
query("a26_concentration", "mv", f"""
WITH w AS (SELECT mv/(SELECT sum(mv) FROM mv) AS w FROM mv) SELECT {rnd('sum(w*w)')} AS hhi, {rnd('max(w)')} AS top1, {rnd('1/sum(w*w)')} AS effective_n, {rnd('(SELECT sum(w) FROM (SELECT w FROM w ORDER BY w DESC LIMIT 5))')} AS top5 FROM w""")(
    lambda v: books.concentration(mv(v, "buy")))
query("j22_weight_parity", "mv", f"""
SELECT isin, {rnd('abs(coalesce(mv/(SELECT sum(mv) FROM mv), 0) - coalesce(mv2/(SELECT sum(mv2) FROM mv), 0))*10000')} AS dev_bps, abs(coalesce(mv/(SELECT sum(mv) FROM mv), 0) - coalesce(mv2/(SELECT sum(mv2) FROM mv), 0))*10000 > 5 AS breach FROM mv""")(
    lambda v: books.weight_parity(*[mv(v, s).select("isin", (c("mv") / mv(v, s).agg(F.sum("mv")).scalar()).alias("weight")) for s in ("buy", "sell")], 5.0))
cte("held", "fills prices", """
SELECT isin, count(*) % 50 + 1.0::DOUBLE AS shares, any_value(lp) AS last_price, any_value(fp) AS cost_basis FROM fills JOIN (SELECT isin, arg_max(close, date) AS lp, arg_min(close, date) AS fp FROM prices GROUP BY isin) USING (isin) GROUP BY isin""")


def held(v):
    ends = v.prices.groupBy("isin").agg(F.max_by("close", "date").alias("last_price"), F.min_by("close", "date").alias("cost_basis"))
    return v.fills.groupBy("isin").agg((F.count("*") % 50 + 1.0).alias("shares")).join(ends, "isin")


query("w57_book_positions", "held", f"""
SELECT isin, {rnd('shares*last_price')} AS mv, {rnd('(last_price/cost_basis - 1)*100')} AS unrealised_pct, {rnd('shares*last_price/(5000 + (SELECT sum(shares*last_price) FROM held))')} AS weight FROM held""")(
    lambda v: books.book_positions(held(v), held(v).select("isin", c("last_price").alias("close")), 5000.0))
cte("ranks", "held", "SELECT isin, row_number() OVER (ORDER BY last_price DESC, isin) AS rank, last_price AS price, isin % 7 <> 3 AS gate_ok, isin % 5 < 2 AS owned, shares FROM held")
query_ranks = lambda v: factors.eligible_ranked(held(v).withColumn("date", F.lit("2001-01-01").cast("date")), c("last_price"), F.lit(True)).select(
    "isin", "rank", c("score").alias("price"), (c("isin") % 7 != 3).alias("gate_ok"))
cte("plan", "ranks", """
WITH t AS (SELECT least(1e6::DOUBLE*0.8/6, 1e6::DOUBLE*0.1) AS t), x AS (SELECT *, owned AND rank <= 9 AND gate_ok AS keep, NOT owned AND rank <= 6 AS fresh FROM ranks),
s AS (SELECT isin FROM x WHERE keep OR fresh ORDER BY CASE WHEN keep THEN 0 ELSE 1 END, rank LIMIT 6)
SELECT isin, side, CASE WHEN side = 'sell' THEN shares ELSE abs(gap)/price END AS qty, price FROM (SELECT x.*, t - CASE WHEN owned THEN shares*price ELSE 0 END AS gap,
 CASE WHEN owned AND NOT keep THEN 'sell' WHEN isin IN (SELECT isin FROM s) AND t - CASE WHEN owned THEN shares*price ELSE 0 END > 1e-9*price THEN 'buy'
 WHEN isin IN (SELECT isin FROM s) AND owned AND t - shares*price < -1e-9*price THEN 'trim' END AS side FROM x, t) WHERE side IS NOT NULL""")
plan = lambda v: books.rebalance_plan(held(v).filter("isin % 5 < 2").select("isin", "shares", "last_price"), query_ranks(v), 1e6, 0.8, n=6, m=9)
query("t09_rebalance_plan", "plan", f"SELECT isin, side, {rounded('qty price')} FROM plan")(plan)
query("t10_plan_turnover", "plan ranks", f"SELECT {rnd('sum(abs(CASE WHEN side = {0} THEN -w WHEN side = {1} THEN qty*price/1e6 ELSE greatest(0, w - qty*price/1e6) - w END))'.replace('{0}', chr(39) + 'sell' + chr(39)).replace('{1}', chr(39) + 'buy' + chr(39)))} AS turnover FROM (SELECT p.*, CASE WHEN owned THEN shares*r.price/1e6 ELSE 0 END AS w FROM plan p JOIN ranks r USING (isin))")(
    lambda v: books.plan_turnover(plan(v), held(v).filter("isin % 5 < 2"), 1e6))
query("t07_most_liquid", "prices", f"SELECT isin, {rnd('adv_20')} AS adv_20 FROM prices WHERE date = (SELECT max(date) FROM prices) AND adv_20 >= 1000 ORDER BY adv_20 DESC, isin LIMIT 10".replace("ORDER BY adv_20", "ORDER BY prices.adv_20"))(
    lambda v: books.most_liquid(v.prices, v.prices.agg(F.max("date")).scalar(), 1000, 10))
for sel, order in (("adv", "adv_20 DESC NULLS LAST"), ("mom", "mom DESC NULLS LAST"), ("random", "md5('11|' || CAST(isin AS VARCHAR))")):
    query(f"t08_candidates_{sel}", "prices", f"""
SELECT {DATE}, isin, row_number() OVER (PARTITION BY date ORDER BY {order}, isin) AS place FROM (SELECT *, close/lag(close, 126) OVER (PARTITION BY isin ORDER BY date) - 1 AS mom FROM prices)""")(
        lambda v, sel=sel: books.order_candidates(v.prices.withColumn("mom", c("close") / F.lag("close", 126).over(Window.partitionBy("isin").orderBy("date")) - 1), sel, 11))
query("t11_newest_alerts", "alerts", "SELECT event_id, symbol, alert_type FROM alerts WHERE alert_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 25")(
    lambda v: books.newest(v.alerts, "ts", "event_id", "error", n=25).select("event_id", "symbol", "alert_type"))
CHECKS = "SELECT date_trunc('month', date)::DATE AS date, arg_max(equity, date) > arg_min(equity, date) AS passed FROM nav GROUP BY 1"
checks = lambda v: v.nav.groupBy(F.trunc("date", "month").alias("date")).agg((F.max_by("equity", "date") > F.min_by("equity", "date")).alias("passed"))
query("w39_clean_clock", "nav", f"WITH k AS ({CHECKS}), r AS (SELECT max(date) FILTER (WHERE NOT passed) AS d FROM k) SELECT count(*) FILTER (WHERE passed AND (d IS NULL OR date > d)) AS clean, CAST(any_value(d) AS VARCHAR) AS reset_date FROM k, r")(
    lambda v: books.clean_clock(checks(v)))
STOPS = "SELECT decision_date, count(*) FILTER (WHERE reason = 'catastrophic_stop') AS stops FROM bfills GROUP BY 1"
CARD = """
WITH k AS ({checks}), r AS (SELECT max(date) FILTER (WHERE NOT passed) AS d FROM k), q AS (SELECT count(*) FILTER (WHERE passed AND (d IS NULL OR date > d)) AS clean, any_value(d) AS reset_date FROM k, r),
g AS (SELECT *, (SELECT count(*) FROM (SELECT DISTINCT date FROM bfills) WHERE date NOT IN (SELECT date FROM nav) AND date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31') = 0 AS complete, (SELECT within FROM (SELECT realized_cost <= pess AS within FROM ledger WHERE decision_date IS NULL)) AS band,
 (SELECT max(stops) FROM ({stops})) >= 1000000 OR (SELECT -min(dd) FROM navr)*100 > {dd} AS killed,
 (SELECT (arg_max(equity, date)/arg_min(equity, date) - arg_max(benchmark, date)/arg_min(benchmark, date))*100 FROM nav WHERE benchmark IS NOT NULL) AS gap FROM q)
SELECT clean, CAST(reset_date AS VARCHAR) AS reset_date, CASE WHEN reset_date IS NULL THEN 'pass' ELSE 'fail' END AS fidelity, CASE WHEN complete THEN 'pass' ELSE 'fail' END AS operational, CASE WHEN band THEN 'pass' ELSE 'fail' END AS cost,
 CASE WHEN gap < -15 THEN 'fail' ELSE 'pass' END AS directional, killed, CASE WHEN killed THEN 'HALT' WHEN NOT complete OR NOT band OR (reset_date IS NOT NULL AND clean = 0) THEN 'AT RISK' WHEN clean >= 6 AND reset_date IS NULL THEN 'GRADUATED' WHEN reset_date IS NOT NULL THEN 'CLOCK RESET' ELSE 'ON TRACK' END AS verdict FROM g"""


def card(v, dd):
    missing = books.missing_days(v.fills.select("date").distinct(), v.nav, F.lit("1998-01-01").cast("date"), F.lit("1998-12-31").cast("date"))
    stops = bfills(v).groupBy("decision_date").agg(F.sum((c("reason") == "catastrophic_stop").cast("int")).alias("stops"))
    return books.scorecard(books.clean_clock(checks(v)), missing, books.cost_ledger(bfills(v)).filter("decision_date IS NULL"), stops, metrics.max_drawdown(v.nav), v.nav, max_stops=1_000_000, max_dd_pct=dd)


for name, dd in (("a39_scorecard", 23.1), ("a39_scorecard_alive", 100.0)):
    query(name, "nav navr bfills ledger", CARD.format(checks=CHECKS, stops=STOPS, dd=dd))(lambda v, dd=dd: card(v, dd))

# --- checks ----------------------------------------------------------------------------------
query("q13_source_comparison", "bars", f"""
SELECT {rnd('0.0')} AS missing_a, {rnd('avg(CASE WHEN day(date) % 5 = 0 THEN 1.0 ELSE 0 END)')} AS missing_b, {rnd('avg(abs(close - close*(1 + (symbol % 3)*0.01::DOUBLE))/close) FILTER (WHERE day(date) % 5 <> 0)')} AS avg_rel_diff,
 {rnd('max(abs(close - close*(1 + (symbol % 3)*0.01::DOUBLE))/close) FILTER (WHERE day(date) % 5 <> 0)')} AS max_rel_diff FROM bars""")(
    lambda v: quality.source_comparison(v.bars, v.bars.withColumn("close", F.when(F.dayofmonth("date") % 5 != 0, c("close") * (1 + (c("symbol") % 3) * F.lit(0.01)))), ["symbol", "date"], "close"))
CUT = "1998-06-30"
query("q14_look_ahead_causal", "prices", "SELECT CAST(0 AS BIGINT) AS changed")(
    lambda v: quality.look_ahead(lambda p: factors.price_factors(p).select("isin", "date", "mom_6_1", "reversal"), v.prices, F.lit(CUT).cast("date"), ["close"]).agg(F.count("*").alias("changed")))


def leaking(p):
    w = Window.partitionBy("isin").orderBy("date")
    return p.select("isin", "date", F.lead("close").over(w).alias("x"))


query("q14_look_ahead_leaking", "prices", f"SELECT CAST(2*count(*) AS BIGINT) AS changed FROM (SELECT date, lead(date) OVER (PARTITION BY isin ORDER BY date) AS n FROM prices) WHERE date <= DATE '{CUT}' AND n > DATE '{CUT}'")(
    lambda v: quality.look_ahead(leaking, v.prices, F.lit(CUT).cast("date"), ["close"]).agg(F.count("*").alias("changed")))
query("q15_identity_breaks", "nav", f"SELECT {DATE}, {rnd('100.0')} AS difference FROM nav WHERE day(date) = 13")(
    lambda v: trades.identity_breaks(v.nav.withColumns({"cash": c("equity") * 0.25, "invested": c("equity") * 0.75 + F.when(F.dayofmonth("date") == 13, 100.0).otherwise(0.0)})))
query("q15_cost_total", "fills", "SELECT round(sum(cost), 1) AS total_cost, round(sum(qty*price*0.001), 1) AS by_fill, true AS equal FROM fills")(
    lambda v: v.fills.agg(F.round(F.sum("cost"), 1).alias("total_cost"), F.round(F.sum(c("qty") * c("price") * 0.001), 1).alias("by_fill"),
                          (F.abs(F.sum("cost") - F.sum(c("qty") * c("price") * 0.001)) <= 1e-6 * F.sum("cost")).alias("equal")))
query("q16_same_rows", "", "SELECT CAST(0 AS BIGINT) AS changed")(
    lambda v: quality.same_rows(factors.price_factors(v.prices), factors.price_factors(v.prices)).agg(F.count("*").alias("changed")))
