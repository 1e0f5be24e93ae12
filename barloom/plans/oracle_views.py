"""DuckDB text of the derived tables in ``barloom.sources.views``, as named CTEs."""

from __future__ import annotations

# name -> (tables it reads, SELECT text), in dependency order.
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def rounded(cols) -> str:
    """Doubles as the Spark side presents them: half-way values nudged, six digits."""
    names = cols.split() if isinstance(cols, str) else cols
    return ", ".join(f"{rnd(c)} AS {c}" for c in names)


def rnd(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE) + 1e-9::DOUBLE, 6)"


def cte(name: str, deps: str, sql: str) -> None:
    CTES[name] = (tuple(deps.split()), sql)


def with_views(names: str, body: str) -> str:
    """Prefix ``body`` with the CTEs it needs, dependencies first."""
    needed: list[str] = []

    def visit(n: str) -> None:
        if n not in needed:
            for d in CTES[n][0]:
                visit(d)
            needed.append(n)

    for n in names.split():
        visit(n)
    parts = [f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in needed]
    body = body.strip()
    if body[:5].upper() == "WITH ":
        body = ", " + body[5:]
    else:
        body = "\n" + body
    return "WITH RECURSIVE " + ",\n".join(parts) + body if parts else body


cte("daily", "", """
SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date, count(*) AS n,
 CAST(sum(CAST(round(l_discount*100) AS BIGINT)) AS BIGINT) AS disc,
 CAST(sum(CAST(round(l_tax*100) AS BIGINT)) AS BIGINT) AS tax,
 CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS volume
FROM lineitem GROUP BY 1, 2""")
cte("walk", "daily", """
SELECT *, round(100.0*exp(CAST(sum(ret_micro) OVER (PARTITION BY symbol ORDER BY date) AS DOUBLE)/1e6), 4) AS close
FROM (SELECT *, CAST(round((CAST(disc AS DOUBLE)/(100.0*n) - 0.05::DOUBLE)*1e6) AS BIGINT) AS ret_micro FROM daily)""")
cte("bars", "walk", """
SELECT symbol, date, open, greatest(open, close)*(1 + half) AS high, least(open, close)*(1 - half) AS low,
 close, volume, close*volume AS traded_value, ret_micro
FROM (SELECT *, coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY date), 100.0::DOUBLE) AS open,
  CAST(tax AS DOUBLE)/(200.0::DOUBLE*n) AS half FROM walk)""")
cte("stocks", "", """
SELECT s_suppkey AS symbol, s_name AS name, r_name AS sector, n_name AS industry,
 CASE WHEN s_acctbal >= 0 THEN s_acctbal*1e7 END AS market_cap
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
cte("idx", "bars", """
SELECT date, round(100.0*exp(sum(r) OVER (ORDER BY date)), 4) AS level
FROM (SELECT date, CAST(sum(ret_micro) AS DOUBLE)/count(*)/1e6 AS r FROM bars GROUP BY date)""")
cte("idxbars", "idx", """
SELECT 'D' AS timeframe, CAST(-1 AS BIGINT) AS symbol, date, open, greatest(open, level)*1.002::DOUBLE AS high,
 least(open, level)*0.998::DOUBLE AS low, level AS close, 1.0::DOUBLE AS volume
FROM (SELECT *, coalesce(lag(level) OVER (ORDER BY date), 100.0::DOUBLE) AS open FROM idx)""")


def resampled(end: str) -> str:
    return f"""
SELECT symbol, date, open, high, low, close, volume FROM (
 SELECT symbol, {end} AS date, arg_min(open, date) AS open, max(high) AS high, min(low) AS low,
  arg_max(close, date) AS close, sum(volume) AS volume, max({end}) = max(max({end})) OVER (PARTITION BY symbol) AS newest
 FROM bars GROUP BY symbol, {end}) WHERE NOT newest"""


WEEK_SUN = "CAST(date_trunc('week', date) AS DATE) + 6"
WEEK_FRI = "date + CAST((5 - isodow(date) + 7) % 7 AS INTEGER)"
MONTH_END = "last_day(date)"
QUARTER_END = "last_day(CAST(date_trunc('quarter', date) + INTERVAL 2 MONTH AS DATE))"

cte("wbars", "bars", resampled(WEEK_SUN))
cte("mbars", "bars", resampled(MONTH_END))
cte("tfbars", "bars wbars mbars", """
SELECT 'D' AS timeframe, symbol, date, open, high, low, close, volume FROM bars
UNION ALL SELECT 'W', * FROM wbars UNION ALL SELECT 'M', * FROM mbars""")


def _rec(x: str, decay: float, start: int, seed: str) -> str:
    """Closed form of a recursive average; valid here because histories stay under 600 bars."""
    alpha = 1.0 - decay
    term = f"CASE WHEN bar < {start} THEN 0 WHEN bar = {start} THEN {seed} ELSE {alpha!r}::DOUBLE*({x}) END"
    return (
        f"CASE WHEN bar >= {start} THEN sum(({term})*pow({decay!r}::DOUBLE, -bar)) OVER w "
        f"* pow({decay!r}::DOUBLE, bar) END"
    )


def ema_sql(x: str, n: int, first: int = 0, seed: str | None = None) -> str:
    d = 1.0 - 2.0 / (n + 1.0)
    return _rec(x, d, first if seed is None else first + n - 1, x if seed is None else seed)


def wilder_sql(x: str, n: int, seed: str, first: int = 0) -> str:
    return _rec(x, 1.0 - 1.0 / n, first + n - 1, seed)


def mean_sql(x: str, n: int) -> str:
    return f"avg({x}) OVER (PARTITION BY timeframe, symbol ORDER BY date ROWS {n - 1} PRECEDING)"


def panel_ctes(prefix: str, source: str) -> None:
    """Indicator panel over ``source`` in four CTEs; the last one is named ``prefix``."""
    win = "WINDOW w AS (PARTITION BY timeframe, symbol ORDER BY date)"
    cte(f"{prefix}_a", source, f"""
SELECT *, CAST(row_number() OVER w - 1 AS BIGINT) AS bar, close - lag(close) OVER w AS move, lag(close) OVER w AS prev,
 high - lag(high) OVER w AS up, lag(low) OVER w - low AS down FROM {source} {win}""")
    cte(f"{prefix}_b", f"{prefix}_a", f"""
SELECT *, {", ".join(f"{mean_sql('close', n)} AS s{n}" for n in (5, 12, 13, 21, 26, 200))},
 {", ".join(f"{mean_sql(c, 14)} AS m_{c}" for c in ("gain", "loss", "tr", "pdm", "mdm"))}
FROM (SELECT *, CASE WHEN bar > 0 THEN greatest(move, 0) END AS gain, CASE WHEN bar > 0 THEN greatest(-move, 0) END AS loss,
 greatest(high - low, abs(high - prev), abs(low - prev)) AS tr,
 CASE WHEN bar > 0 THEN CASE WHEN up > down AND up > 0 THEN up ELSE 0 END END AS pdm,
 CASE WHEN bar > 0 THEN CASE WHEN down > up AND down > 0 THEN down ELSE 0 END END AS mdm FROM {prefix}_a)""")
    emas = ", ".join(
        f"{ema_sql('close', n, seed=f's{n}')} AS {name}"
        for name, n in (("ema5", 5), ("e12", 12), ("ema13", 13), ("ema21", 21), ("e26", 26), ("ema200", 200))
    )
    wild = ", ".join(f"{wilder_sql(c, 14, f'm_{c}', 1)} AS w_{c}" for c in ("gain", "loss", "tr", "pdm", "mdm"))
    cte(f"{prefix}_c", f"{prefix}_b", f"""
SELECT *, {emas}, {wild}, {wilder_sql('tr', 14, 'm_tr')} AS atr FROM {prefix}_b {win}""")
    cte(f"{prefix}_d", f"{prefix}_c", f"""
SELECT *, {mean_sql('macd', 9)} AS m_macd, {mean_sql('dx', 14)} AS m_dx FROM (
 SELECT *, e12 - e26 AS macd, CASE WHEN w_gain + w_loss > 0 THEN 100.0*w_gain/(w_gain + w_loss) END AS rsi,
 CASE WHEN bar >= 14 THEN coalesce(100.0*abs(w_pdm/w_tr - w_mdm/w_tr)/nullif(w_pdm/w_tr + w_mdm/w_tr, 0), 0) END AS dx
 FROM {prefix}_c)""")
    cte(prefix, f"{prefix}_d", f"""
SELECT timeframe, symbol, date, open, high, low, close, volume, bar, ema5, ema13, ema21, ema200, macd, rsi, atr,
 {ema_sql('macd', 9, 25, 'm_macd')} AS macd_signal, {wilder_sql('dx', 14, 'm_dx', 14)} AS adx,
 CASE WHEN bar >= 19 THEN avg(volume) OVER (PARTITION BY timeframe, symbol ORDER BY date ROWS 19 PRECEDING) END AS vol_sma20,
 (ema21 - lag(ema21, 5) OVER w)/5.0 AS ema_slope_21,
 max(close) OVER (PARTITION BY timeframe, symbol ORDER BY date ROWS 251 PRECEDING) AS week52_high,
 min(close) OVER (PARTITION BY timeframe, symbol ORDER BY date ROWS 251 PRECEDING) AS week52_low,
 max(close) OVER (PARTITION BY timeframe, symbol ORDER BY date ROWS BETWEEN 259 PRECEDING AND 20 PRECEDING) AS resistance_level,
 (close/lag(close, 21) OVER w - 1)*100 AS momentum_1m, (close/lag(close, 63) OVER w - 1)*100 AS momentum_3m,
 (close/lag(close, 126) OVER w - 1)*100 AS momentum_6m, (close/lag(close, 252) OVER w - 1)*100 AS momentum_12m
FROM {prefix}_d {win}""")


panel_ctes("panel", "tfbars")
panel_ctes("idxpanel", "idxbars")

cte("sig_a", "panel", """
SELECT *, close > ema200 AS above_200ema, (close/week52_high - 1)*100 AS pct_from_52w_high,
 (close/week52_low - 1)*100 AS pct_from_52w_low, (close/resistance_level - 1)*100 AS pct_from_resistance,
 coalesce(vol_sma20 > 0 AND volume > 2.0*vol_sma20 AND close > open, false) AS volume_breakout,
 timeframe = 'D' AND coalesce(bar >= 16 AND plow > 0 AND (phigh - plow)/plow*100 <= 12.0, false) AS is_consolidating,
 (close/lag(close) OVER w - 1)*100 AS price_change_pct,
 bar >= CASE WHEN timeframe = 'M' THEN 23 ELSE 59 END AS ready,
 coalesce(ema5 > ema13 AND lag(ema5) OVER w <= lag(ema13) OVER w, false) AS crossed,
 coalesce(ema5 > ema13 AND close > ema21 AND abs(close - ema21)/ema21 < 0.03, false) AS pull,
 coalesce(ema5 > ema13 AND ema13 > ema21, false) AS stack, coalesce(ema5 < ema13 AND ema13 < ema21, false) AS sink,
 coalesce(macd > macd_signal AND lag(macd) OVER w <= lag(macd_signal) OVER w, false) AS mcross,
 coalesce(macd > macd_signal, false) AS mup, lag(rsi) OVER w AS prsi,
 coalesce(min(rsi) OVER (PARTITION BY timeframe, symbol ORDER BY date ROWS 4 PRECEDING) < 30, false) AS oversold
FROM (SELECT *, max(high) OVER p AS phigh, min(low) OVER p AS plow FROM panel
 WINDOW p AS (PARTITION BY timeframe, symbol ORDER BY date ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING))
WINDOW w AS (PARTITION BY timeframe, symbol ORDER BY date)""")
cte("sig_b", "sig_a", """
SELECT *, CASE WHEN NOT live THEN 'neutral' WHEN crossed THEN 'bullish_cross' WHEN pull THEN 'bullish_pullback'
  WHEN stack AND coalesce(close > ema21, false) THEN 'bullish' WHEN sink THEN 'bearish' ELSE 'neutral' END AS ema0,
 CASE WHEN NOT live OR rsi IS NULL OR prsi IS NULL THEN 'neutral' WHEN rec AND crossed THEN 'bullish_recovery_confirmed'
  WHEN rec THEN 'bullish_recovery' WHEN prsi <= 50 AND rsi > 50 THEN 'bullish_crossing'
  WHEN rsi > 50 AND rsi <= 65 THEN 'bullish_strong' WHEN rsi > 65 AND rsi <= 68 THEN 'bullish_extended' ELSE 'neutral' END AS rsi_signal,
 CASE WHEN live AND volume_breakout THEN 'bullish' ELSE 'neutral' END AS volume_signal,
 coalesce(rsi > 65, false) OR coalesce(close < ema200, false) OR coalesce(adx < 20, false) AS veto
FROM (SELECT *, ready AND timeframe = 'D' AS live, oversold AND coalesce(rsi > 30 AND close > ema21, false) AS rec FROM sig_a)""")
cte("sig_c", "sig_b", """
SELECT *, CASE WHEN coalesce(above_200ema, false) THEN 7.0 ELSE 0 END AS pts_ema200,
 28.5*CASE ema0 WHEN 'bullish_cross' THEN 1.0 WHEN 'bullish_pullback' THEN 21.5::DOUBLE/28.5 WHEN 'bullish' THEN 11.5::DOUBLE/28.5 ELSE 0 END AS pts_ema,
 21.5*CASE WHEN NOT live THEN 0 WHEN mcross AND crossed THEN 11.5::DOUBLE/21.5 WHEN mcross THEN 1.0
  WHEN mup AND macd > 0 THEN 14.5::DOUBLE/21.5 WHEN mup AND macd < 0 THEN 7.0::DOUBLE/21.5 ELSE 0 END AS pts_macd,
 21.5*CASE WHEN rsi_signal LIKE 'bullish_recovery%' THEN 1.0 WHEN rsi_signal = 'bullish_crossing' THEN 14.5::DOUBLE/21.5
  WHEN rsi_signal = 'bullish_strong' THEN 7.0::DOUBLE/21.5 ELSE 0 END AS pts_rsi,
 CASE WHEN volume_signal = 'bullish' THEN 21.5 ELSE 0 END AS pts_volume,
 CASE WHEN live THEN least(7.0, CASE WHEN adx >= 35 THEN 4.5 WHEN adx >= 25 THEN 3.0 WHEN adx >= 20 THEN 1.5 ELSE 0 END
  + CASE WHEN momentum_3m > 15 THEN 3.0 WHEN momentum_3m > 5 THEN 1.5 ELSE 0 END) ELSE 0 END AS pts_trend,
 ready AND CASE timeframe WHEN 'D' THEN (crossed OR pull OR stack) AND mup AND coalesce(rsi > 35, false) AND NOT veto
  WHEN 'W' THEN coalesce(rsi > 50 AND close > ema21, false)
  ELSE coalesce(rsi > 50 AND (close > ema13 OR close > ema21), false) END AS is_bullish,
 live AND coalesce(rsi > 80, false) AS is_overextended FROM sig_b""")
SIG_DOUBLES = """open high low close volume ema5 ema13 ema21 ema200 macd rsi atr macd_signal adx vol_sma20 ema_slope_21
week52_high week52_low resistance_level momentum_1m momentum_3m momentum_6m momentum_12m pct_from_52w_high pct_from_52w_low
pct_from_resistance price_change_pct pts_ema200 pts_ema pts_macd pts_rsi pts_volume pts_trend""".split()
cte("sig_d", "sig_c", f"""
SELECT timeframe, symbol, date, bar, {rounded(SIG_DOUBLES)},
 above_200ema, volume_breakout, is_consolidating, rsi_signal, volume_signal, is_bullish, is_overextended,
 CASE WHEN ready AND timeframe <> 'D' AND is_bullish THEN 'bullish' ELSE ema0 END AS ema_signal,
 round(1e-9::DOUBLE + CAST(CASE WHEN NOT ready THEN pts_ema200 WHEN timeframe <> 'D' THEN CASE WHEN is_bullish THEN 100.0 ELSE 0 END
  WHEN veto THEN 0 ELSE greatest(0, least(100.0, pts_ema200 + pts_ema + pts_macd + pts_rsi + pts_volume + pts_trend)) END AS DOUBLE), 6) AS entry_score
FROM sig_c""")
cte("signals", "sig_d", """
SELECT *, round(CASE WHEN ok THEN CAST(row_number() OVER (PARTITION BY timeframe, date, ok ORDER BY momentum_12m, symbol) AS DOUBLE)
 / count(*) OVER (PARTITION BY timeframe, date, ok) * 100 END + 1e-9::DOUBLE, 6) AS rs_score
FROM (SELECT *, momentum_12m IS NOT NULL AND timeframe = 'D' AS ok FROM sig_d)""")

cte("events_ca", "", """
SELECT 'INE' || lpad(CAST(isin AS VARCHAR), greatest(6, length(CAST(isin AS VARCHAR)))::INTEGER, '0') || '010' AS isin, isin AS symbol, e.d AS ex_date, e.p AS pri,
 CASE e.p WHEN '1-URGENT' THEN 'split' WHEN '2-HIGH' THEN 'bonus' ELSE 'dividend' END AS type,
 CASE WHEN e.p IN ('1-URGENT', '2-HIGH') THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS ratio,
 CASE WHEN e.p NOT IN ('1-URGENT', '2-HIGH') THEN 1.0::DOUBLE END AS dividend
FROM (SELECT o_custkey % (SELECT count(*) FROM supplier) AS isin, year(o_orderdate) AS y,
 min({'d': CAST(o_orderdate AS DATE), 'k': o_orderkey, 'p': o_orderpriority}) AS e FROM orders GROUP BY 1, 2)""")
cte("legs", "bars", """
SELECT * EXCLUDE (rn, cnt), 'INE' || lpad(CAST(symbol AS VARCHAR), greatest(6, length(CAST(symbol AS VARCHAR)))::INTEGER, '0') || '0' ||
 CASE WHEN symbol % 10 = 0 AND rn*2 > cnt THEN '2' ELSE '1' END || '0' AS isin
FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn, count(*) OVER (PARTITION BY symbol) AS cnt FROM bars)""")
cte("lifetimes", "legs", """
SELECT isin, symbol, min(date) AS first_date, max(date) AS last_date FROM legs GROUP BY 1, 2""")
cte("ev_assigned", "legs events_ca", """
SELECT e.* FROM events_ca e WHERE e.isin IN (SELECT isin FROM legs)
UNION ALL SELECT e.* REPLACE (s.isin AS isin) FROM (SELECT isin, arg_min(symbol, date) AS symbol, min(date) AS a, max(date) AS b
 FROM legs GROUP BY isin) s JOIN events_ca e ON e.symbol = s.symbol AND e.ex_date BETWEEN s.a AND s.b
WHERE s.isin NOT IN (SELECT isin FROM events_ca)""")
cte("ev_mult", "ev_assigned legs", """
SELECT e.isin, e.ex_date, e.type, CASE WHEN e.type <> 'dividend' THEN ratio END AS cap, l.close AS prior_close,
 CASE WHEN e.type <> 'dividend' THEN ratio WHEN l.close > 0 AND dividend > 0 AND 1 - dividend/l.close > 0 THEN 1 - dividend/l.close END AS tot
FROM ev_assigned e ASOF LEFT JOIN legs l ON e.isin = l.isin AND e.ex_date > l.date""")
cte("adjusted", "ev_mult legs", """
SELECT l.isin, l.symbol, l.date, open*f.adj AS open, high*f.adj AS high, low*f.adj AS low, close*f.adj AS close,
 close AS close_raw, close*f.tr AS close_tr, volume, traded_value, f.adj AS adj_factor, f.tr AS tr_factor,
 median(traded_value) OVER (PARTITION BY l.isin ORDER BY l.date ROWS 19 PRECEDING) AS adv_20
FROM legs l JOIN (SELECT b.isin, b.date, coalesce(product(m.cap), 1.0) AS adj, coalesce(product(m.tot), 1.0) AS tr
 FROM legs b LEFT JOIN ev_mult m ON m.isin = b.isin AND m.ex_date > b.date GROUP BY 1, 2) f ON f.isin = l.isin AND f.date = l.date""")
LINE_ID = (
    "CAST('0x' || substr(md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(round(l_quantity*100) AS BIGINT),"
    " CAST(round(l_extendedprice*100) AS BIGINT), CAST(round(l_discount*100) AS BIGINT), CAST(round(l_tax*100) AS BIGINT),"
    " l_returnflag, l_linestatus, CAST(CAST(l_shipdate AS DATE) AS VARCHAR))), 1, 15) AS BIGINT)"
)
cte("fills", "", f"""
SELECT l_suppkey AS isin, CASE l_returnflag WHEN 'N' THEN 'buy' WHEN 'R' THEN 'sell' ELSE 'trim' END AS side,
 l_quantity AS qty, l_extendedprice AS price, CAST(l_shipdate AS DATE) AS date, l_quantity*l_extendedprice*0.001 AS cost,
 {LINE_ID} AS fill_id, l_linestatus AS reason FROM lineitem""")
cte("trades", "stocks", f"""
SELECT l_suppkey AS symbol, CAST(o_orderdate AS DATE) AS entry_date,
 CAST(o_orderdate AS DATE) + CAST(l_quantity AS INTEGER) AS exit_date,
 CAST(CAST(round(l_tax*100) AS BIGINT) - CAST(round(l_discount*100) AS BIGINT) + 1 AS DOUBLE) AS return_pct,
 l_extendedprice AS size, l_returnflag AS exit_reason, o_orderstatus AS regime, CAST(l_quantity AS INTEGER) AS holding_days,
 {LINE_ID} AS trade_id, sector
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN stocks ON symbol = l_suppkey""")
cte("journal", "bars", f"""
SELECT l_suppkey AS symbol, {LINE_ID} AS trade_id, b.date AS entry_date, b.date AS signal_date,
 b.date + CAST(l_quantity AS INTEGER) AS exit_date, CASE WHEN l_linestatus = 'O' THEN 'open' ELSE 'closed' END AS status,
 l_quantity AS qty, b.close AS entry_price, b.close*(1 + l_tax - l_discount) AS exit_price, b.close*(1 - l_tax) AS stop_loss,
 b.close*(1 + 2*l_discount) AS target, b.close*(1 - l_tax) AS planned_entry_low, b.close*(1 + l_tax) AS planned_entry_high
FROM lineitem JOIN bars b ON b.symbol = l_suppkey AND b.date = CAST(l_shipdate AS DATE)""")
cte("last_bars", "panel", """
SELECT symbol, date, high, low, close, rsi, ema21, prev_low, bar FROM (
 SELECT *, lag(low) OVER (PARTITION BY symbol ORDER BY date) AS prev_low, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS n
 FROM panel WHERE timeframe = 'D') WHERE n = 1""")
cte("nav", "idx", """
SELECT n.date, n.equity, i.level AS benchmark FROM (
 SELECT date, round(1e6 + sum((a - m)/10.0) OVER (ORDER BY date) + 1e-6::DOUBLE, 4) AS equity FROM (
  SELECT date, a, round(avg(a) OVER (), 2) AS m FROM (SELECT CAST(o_orderdate AS DATE) AS date,
   CAST(sum(CAST(round(o_totalprice*100) AS BIGINT)) AS DOUBLE)/count(*)/100.0 AS a FROM orders GROUP BY 1))) n
ASOF LEFT JOIN idx i ON n.date >= i.date""")
cte("filings", "", f"""
SELECT isin, period_end, period_end + CASE version WHEN 'F' THEN 20 WHEN 'O' THEN 50 ELSE 80 END AS available_date,
 statement_type, net_income*10 AS revenue, net_income, net_income*1.5::DOUBLE AS ebit, net_income*8 AS total_equity,
 net_income*20 AS total_assets, CASE WHEN version <> 'O' THEN net_income*4 END AS total_debt,
 CAST(isin + 1000 AS DOUBLE) AS shares_outstanding, CASE WHEN version <> 'P' THEN net_income*0.9::DOUBLE END AS cfo,
 CASE WHEN version <> 'F' THEN 0.5::DOUBLE END AS debt_equity_ratio
FROM (SELECT isin, version, {QUARTER_END} AS period_end, 'Quarterly' AS statement_type, CAST(sum(c) AS DOUBLE)/1e5 AS net_income FROM o GROUP BY 1, 2, 3
 UNION ALL SELECT isin, version, make_date(year(date), 12, 31), 'Annual', CAST(sum(c) AS DOUBLE)/1e5 FROM o GROUP BY 1, 2, 3)""".replace(
    "FROM o ", "FROM (SELECT o_custkey % (SELECT count(*) FROM supplier) AS isin, CAST(o_orderdate AS DATE) AS date, o_orderstatus AS version, "
    "CAST(round(o_totalprice*100) AS BIGINT) AS c FROM orders) "))
cte("alerts", "", """
SELECT event_id, ts, CAST(ts AS DATE) AS date, user_id % (SELECT count(*) FROM supplier) AS symbol,
 event_type AS alert_type, value AS price FROM events""")
