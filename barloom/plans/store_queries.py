"""Registered queries: sources, sinks, corporate actions, identity, store checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import text
from barloom.operators import adjust, calendar, fundamentals, identity, quality
from barloom.plans.oracle_views import cte, rnd, rounded
from barloom.plans.registry import query
from barloom.sources import storage
from barloom.sources.views import LIQUIDITY_FLOOR, padded

c = F.col
DATE = "CAST(date AS VARCHAR) AS date"
BAR = "open high low close traded_value"

# --- bar files -------------------------------------------------------------


def bar_text(v, layout: str):
    """Bars written as the text columns of a published layout, with rows to reject."""
    f = storage.LEGACY_FIELDS if layout == "legacy" else storage.UDIFF_FIELDS
    pad = lambda x: F.concat(F.lit(" "), x.cast("string"), F.lit(" "))
    s = c("symbol")
    fmt = (
        F.when((F.year("date") >= 2000) & (F.month("date") % 2 == 0), F.upper(F.date_format("date", "dd-MMM-yy"))).otherwise(
            F.date_format("date", "dd-MMM-yyyy"))
        if layout == "legacy" else c("date").cast("string")
    )
    price = lambda k: F.when(s % 9 == 5, F.lit("NA")).otherwise(pad(F.round(c(k) * 100).cast("long")))
    df = v.bars.select(
        F.when(s % 7 != 3, F.concat(F.lit("INE"), s.cast("string"))).alias(f["isin"]),
        pad(s).alias(f["symbol"]),
        fmt.alias(f["date"]),
        *[price(k).alias(f[k]) for k in ("open", "high", "low", "close")],
        pad(c("volume").cast("long")).alias(f["volume"]),
        pad(F.round(c("traded_value") * 100).cast("long")).alias(f["traded_value"]),
        F.when(F.dayofmonth("date") == 13, "BE").otherwise(" EQ ").alias(f["series"]),
        F.when(F.month("date") == 12, "FUT").otherwise("STK").alias("FinInstrmTp"),
        F.when(F.month("date") == 11, "2030-01-01").otherwise("-").alias("XpryDt"),
    )
    return df


def bar_sql(where: str) -> str:
    cents = ", ".join(f"CAST(CAST(round({k}*100) AS BIGINT) AS DOUBLE) AS {k}" for k in BAR.split())
    return f"""SELECT 'INE' || CAST(symbol AS VARCHAR) AS isin, CAST(symbol AS VARCHAR) AS symbol, {DATE}, {cents},
 CAST(volume AS BIGINT) AS volume, 'EQ' AS series FROM bars WHERE symbol % 7 <> 3 AND symbol % 9 <> 5 AND day(date) <> 13 {where}"""


query("s01_legacy_bar_rows", "bars", bar_sql(""))(lambda v: storage.legacy_bars(bar_text(v, "legacy")))
query("s02_udiff_bar_rows", "bars", bar_sql("AND month(date) NOT IN (11, 12)"))(lambda v: storage.udiff_bars(bar_text(v, "udiff")))


def stored(v):
    path = storage.scratch_path(v.spark, "prices")
    storage.write_by_year(v.adjusted, path, "isin")
    return path


PRICE_OUT = f"isin, symbol, {DATE}, {rounded('close close_tr adv_20')}"
query("s03_price_scan", "adjusted", f"SELECT {PRICE_OUT} FROM adjusted WHERE isin IN ('INE000001010', 'INE000002010') AND date BETWEEN '1997-03-01' AND '1999-02-28'")(
    lambda v: storage.read_prices(v.spark, stored(v), isins=["INE000001010", "INE000002010"], start="1997-03-01", end="1999-02-28").select(
        "isin", "symbol", "date", "close", "close_tr", "adv_20"))


def membership_path(v):
    path = storage.scratch_path(v.spark, "membership")
    storage.write_by_year(identity.universe(v.adjusted)[1], path)
    return path


query("s04_membership_scan", "legs", f"SELECT DISTINCT isin, {DATE} FROM legs WHERE date BETWEEN '1996-06-01' AND '1998-06-30'")(
    lambda v: storage.read_membership(v.spark, membership_path(v), start="1996-06-01", end="1998-06-30"))


def small_tables(v):
    path = storage.scratch_path(v.spark, "symbols")
    v.lifetimes.write.mode("overwrite").parquet(path)
    have = storage.read_or_empty(v.spark, path, storage.SYMBOL_MAP)
    none = storage.read_or_empty(v.spark, path + "-absent", storage.SYMBOL_MAP).select(*have.columns)
    return have.withColumn("symbol", c("symbol").cast("string")).unionByName(none.withColumn("symbol", c("symbol").cast("string")))


query("s05_symbol_map_scan", "lifetimes", "SELECT isin, CAST(symbol AS VARCHAR) AS symbol, CAST(first_date AS VARCHAR) AS first_date, CAST(last_date AS VARCHAR) AS last_date FROM lifetimes")(small_tables)


def overwrite_twice(v):
    path = storage.scratch_path(v.spark, "overwrite")
    df = v.bars.select("symbol", "date", "close")
    storage.write_by_year(df, path)
    storage.write_by_year(df.filter(F.year("date") == 1998).withColumn("close", c("close") * 2), path)
    storage.write_by_year(df.filter(F.year("date") == 1998), path)
    return v.spark.read.parquet(path).groupBy("year").agg(F.count("*").alias("rows"), F.sum("close").alias("total"))


query("s06_partition_overwrite", "bars", f"SELECT year(date) AS year, count(*) AS rows, {rnd('sum(close)')} AS total FROM bars GROUP BY 1")(overwrite_twice)
query("s07_price_contract", "adjusted", f"""
SELECT isin, CAST(symbol AS VARCHAR) AS symbol, {DATE}, {rounded('open high low close close_raw close_tr traded_value adv_20 adj_factor tr_factor')},
 CAST(volume AS BIGINT) AS volume, 'EQ' AS series, isin AS instrument_id FROM adjusted""")(
    lambda v: storage.conform(v.adjusted.withColumns({"series": F.lit("EQ"), "instrument_id": c("isin")}), storage.PRICES_ADJUSTED, "prices"))
query("s08_index_levels", "idx", f"SELECT {DATE}, CAST(CAST(round(level*100) AS BIGINT) AS DOUBLE) AS level FROM idx")(
    lambda v: storage.index_levels(v.index.select(F.to_json(F.struct(
        F.date_format("date", "dd MMM yyyy").alias("Date"),
        F.format_number(F.round(c("level") * 100).cast("long"), 0).alias("TotalReturnsIndex"))).alias("json"))))
query("s09_daily_volatility", "", f"SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, {rnd('arg_max(value, {0})')} AS india_vix FROM events WHERE event_type <> 'error' GROUP BY 1".replace("{0}", "{'t': ts, 'v': value}"))(
    lambda v: storage.daily_volatility(v.table("events").select("ts", F.when(c("event_type") != "error", c("value")).alias("value"))))
SECTORS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


def sector_wide(v):
    daily = v.bars.join(v.stocks.select("symbol", "sector"), "symbol")
    return daily.groupBy("date").agg(*[
        f(F.when(c("sector") == s, c(k))).alias(f"{s}_{k}") for s in SECTORS for k, f in (("high", F.max), ("low", F.min), ("volume", F.sum))])


query("s10_wide_to_long", "bars stocks", f"SELECT {DATE}, sector AS symbol, {rnd('max(high)')} AS high, {rnd('min(low)')} AS low, {rnd('sum(volume)')} AS volume FROM bars JOIN stocks USING (symbol) GROUP BY date, sector")(
    lambda v: storage.wide_to_long(sector_wide(v), SECTORS, ("high", "low", "volume")))


def signal_versions(v):
    old = v.bars.select("symbol", "date", F.lit("D").alias("timeframe"), c("close").alias("score"), F.lit(1).alias("scored_at"))
    new = old.filter(F.year("date") >= 2000).withColumns({"score": c("score") * 2, "scored_at": F.lit(2)})
    return storage.upsert(old, new, ["symbol", "date", "timeframe"], "scored_at")


query("s11_signal_upsert", "bars", f"SELECT symbol, {DATE}, 'D' AS timeframe, {rnd('CASE WHEN year(date) >= 2000 THEN close*2 ELSE close END')} AS score, CASE WHEN year(date) >= 2000 THEN 2 ELSE 1 END AS scored_at FROM bars")(signal_versions)


def retention(v):
    from barloom.operators.indicators import stack_timeframes

    path = storage.scratch_path(v.spark, "retention")
    df = stack_timeframes(v.bars)
    storage.write_partitions(df.withColumn("year", F.year("date")).repartition("timeframe", "year"), path, ["timeframe", "year"])
    today = df.agg(F.max("date")).first()[0]
    gone = storage.clean_up(v.spark, {"signals": storage.Retention(path, 730, {"D": 90, "W": 730, "M": 730})}, today)
    kept = v.spark.read.parquet(path).groupBy("timeframe").agg(F.count("*").alias("kept"))
    deleted = v.spark.createDataFrame([(k.removeprefix("signals_"), n) for k, n in gone.items()], "timeframe string, deleted long")
    return kept.join(deleted, "timeframe", "full_outer")


query("s12_retention", "tfbars", """
SELECT timeframe, count(*) FILTER (WHERE k) AS kept, count(*) FILTER (WHERE NOT k) AS deleted FROM (
 SELECT timeframe, (SELECT max(date) FROM tfbars) - date <= CASE timeframe WHEN 'D' THEN 90 ELSE 730 END AS k FROM tfbars) GROUP BY timeframe""")(retention)
query("s13_listings", "legs", """
SELECT isin, arg_max(symbol, date) AS symbol, CAST(min(date) AS VARCHAR) AS list_date,
 CASE WHEN max(date) <> (SELECT max(date) FROM legs) THEN CAST(max(date) AS VARCHAR) END AS delist_date FROM legs GROUP BY isin""")(
    lambda v: storage.listings(v.legs))


def index_rows(v):
    """The index after two runs, the second with all of the first's filings again, and the second run's errors."""
    base = v.filings.select("isin", "period_end", "statement_type", F.when(c("isin") % 10 == 3, F.date_sub("available_date", 60)).otherwise(c("available_date")).alias("available_date"))
    path, errors = storage.scratch_path(v.spark, "filing-index"), storage.scratch_path(v.spark, "filing-errors")
    storage.populate_filing_index(base.filter(F.year("period_end") < 1998), path, errors, "first")
    storage.populate_filing_index(base, path, errors, "second")
    good = v.spark.read.parquet(path).drop("year").withColumn("error", F.lit(None).cast("string"))
    return good.unionByName(v.spark.read.parquet(errors).filter("run_id = 'second'").select(*good.columns))


query("s14_filing_index", "filings", """
SELECT isin, CAST(period_end AS VARCHAR) AS period_end, statement_type, CAST(a AS VARCHAR) AS available_date,
 CASE WHEN a <= period_end THEN 'available_date <= period_end' END AS error FROM (SELECT *, CASE WHEN isin % 10 = 3 THEN available_date - 60 ELSE available_date END AS a FROM filings)""")(index_rows)
KEY = ["isin", "period_end", "statement_type", "available_date"]


def appended(v):
    f = v.filings.select(*KEY, "net_income", "cfo")
    old = f.filter(F.year("period_end") <= 1998)
    new = f.filter(F.year("period_end") >= 1998).withColumn("net_income", c("net_income") * 3)
    return storage.append_new(old, new, KEY)


FKEY = "isin, CAST(period_end AS VARCHAR) AS period_end, statement_type, CAST(available_date AS VARCHAR) AS available_date"
query("s15_append_versions", "filings", f"SELECT {FKEY}, {rnd('CASE WHEN year(period_end) <= 1998 THEN net_income ELSE net_income*3 END')} AS net_income, {rnd('cfo')} AS cfo FROM filings")(appended)
query("s15_unmapped_items", "filings", f"""
SELECT {FKEY}, unmapped_item FROM (SELECT *, unnest(['total_debt', 'cfo', 'debt_equity_ratio']) AS unmapped_item FROM filings)
WHERE CASE unmapped_item WHEN 'total_debt' THEN total_debt WHEN 'cfo' THEN cfo ELSE debt_equity_ratio END IS NULL""")(
    lambda v: storage.missing_item_errors(v.filings, KEY, ["net_income", "total_debt", "cfo", "debt_equity_ratio"]))


def corrected(v):
    f = v.filings.select(*KEY, "net_income", "cfo")
    return storage.correct(f.filter(F.year("period_end") <= 1999),
                           f.filter(F.year("period_end") >= 1998).withColumn("cfo", F.lit(None).cast("double")), KEY, ["net_income", "cfo"])


query("s17_reparsed_items", "filings", f"SELECT {FKEY}, {rnd('net_income')} AS net_income, {rnd('CASE WHEN year(period_end) < 1998 THEN cfo END')} AS cfo FROM filings")(corrected)


def journal_sync(v):
    """Open positions first, then every position; a closed state is the later version."""
    pos = v.journal.withColumn("version", F.when(c("status") == "closed", 2).otherwise(1))
    first = storage.sync_positions(_no_journal(v), pos.filter("status = 'open'"))
    return storage.sync_positions(first, pos).groupBy("status").agg(
        F.count("*").alias("n"), F.count("exit_date").alias("with_exit"), F.max("version").alias("version"))


def _no_journal(v):
    return v.journal.filter(F.lit(False)).select(
        F.lit("paper").alias("source"), c("trade_id").alias("external_id"), "symbol", "entry_date", "entry_price", "status",
        "exit_date", "exit_price", c("qty").alias("pnl"), F.lit(0).alias("version"))


query("s19_journal_sync", "journal", """
SELECT CASE WHEN k THEN 'closed' ELSE 'open' END AS status, count(*) AS n, count(*) FILTER (WHERE k) AS with_exit, CASE WHEN k THEN 2 ELSE 1 END AS version
FROM (SELECT trade_id, bool_or(status = 'closed') AS k FROM journal GROUP BY 1) GROUP BY k""")(journal_sync)

# --- corporate actions -----------------------------------------------------
SUBJECT = """CASE o_orderkey % 9
 WHEN 0 THEN 'Face Value Split From Rs 10/- Per Share To Rs ' || CAST(o_custkey % 5 + 1 AS STRING) || '/- Per Share'
 WHEN 1 THEN 'Bonus ' || CAST(o_custkey % 3 + 1 AS STRING) || ':' || CAST(o_custkey % 4 + 1 AS STRING)
 WHEN 2 THEN 'Interim Dividend - Rs. ' || CAST(o_custkey % 7 + 1 AS STRING) || '.50 Per Share'
 WHEN 3 THEN 'Interim Dividend Rs 2 And Special Dividend Re ' || CAST(o_custkey % 9 + 1 AS STRING)
 WHEN 4 THEN 'Dividend ' || CAST(o_custkey % 90 + 10 AS STRING) || '% on face value'
 WHEN 5 THEN 'Annual General Meeting'
 WHEN 6 THEN 'Sub-Division 1:' || CAST(o_custkey % 9 + 2 AS STRING)
 WHEN 7 THEN 'Dividend and Final dividend Rs ' || CAST(o_custkey % 6 + 1 AS STRING)
 ELSE 'Bonus to be announced' END"""
FEED = f"""SELECT CASE WHEN o_orderkey % 50 = 7 THEN '' ELSE 'INE' || CAST(o_custkey AS STRING) END AS isin, CAST(o_custkey AS STRING) AS symbol,
 {SUBJECT} AS subject, CASE WHEN o_orderkey % 40 = 11 THEN 'n/a' ELSE {{day}} END AS ex_date_raw, CASE WHEN o_custkey % 5 = 0 THEN '-' ELSE '10' END AS face_value FROM {{t}}"""


def feed(v):
    sql = FEED.replace("{day}", "date_format(o_orderdate, 'dd-MMM-yyyy')").replace("{t}", "{orders}")
    return v.spark.sql(sql, orders=v.table("orders"))


AMT = r"(?i)(?:rs|re)\.?\s*([0-9]+(?:\.[0-9]+)?)"
FV = r"(?is)(?:rs|re)\.?\s*([0-9]+(?:\.[0-9]+)?)\D+?to\b\D*?(?:rs|re)\.?\s*([0-9]+(?:\.[0-9]+)?)"
cte("feed", "", FEED.replace("{day}", "strftime(o_orderdate, '%d-%b-%Y')").replace("{t}", "orders").replace("AS STRING", "AS VARCHAR"))
cte("ca_typed", "feed", f"""
SELECT *, CASE WHEN regexp_matches(s, 'split|sub-division|sub division|subdivision|consolidation') THEN 'split' WHEN contains(s, 'dividend') THEN
  CASE WHEN contains(s, 'bonus') THEN 'bonus' ELSE 'dividend' END WHEN contains(s, 'face value') AND regexp_matches(subject, '{FV}') THEN 'split'
  WHEN contains(s, 'bonus') THEN 'bonus' END AS type, try_cast(regexp_extract(subject, '{FV}', 1) AS DOUBLE) AS fo, try_cast(regexp_extract(subject, '{FV}', 2) AS DOUBLE) AS fn,
 try_cast(regexp_extract(subject, '(\\d+)\\s*:\\s*(\\d+)', 1) AS DOUBLE) AS ra, try_cast(regexp_extract(subject, '(\\d+)\\s*:\\s*(\\d+)', 2) AS DOUBLE) AS rb,
 try_cast(regexp_extract(subject, '([0-9]+(?:\\.[0-9]+)?)\\s*%', 1) AS DOUBLE) AS pct, try_cast(face_value AS DOUBLE) AS face,
 list_filter([try_cast(nullif(regexp_extract(p1, '{AMT}', 1), '') AS DOUBLE), try_cast(nullif(regexp_extract(p2, '{AMT}', 1), '') AS DOUBLE)], lambda x: x IS NOT NULL) AS amts
FROM (SELECT *, lower(subject) AS s, substr(lower(subject), nullif(instr(lower(subject), 'dividend'), 0) + 8) AS p1,
 substr(substr(lower(subject), nullif(instr(lower(subject), 'dividend'), 0) + 8), nullif(instr(substr(lower(subject), nullif(instr(lower(subject), 'dividend'), 0) + 8), 'dividend'), 0) + 8) AS p2 FROM feed)""")
cte("ca_parsed", "ca_typed", """
SELECT *, CASE WHEN isin = '' THEN 'missing isin (cannot join)' WHEN ex_date_raw = 'n/a' THEN 'unparseable ex-date' WHEN type IS NULL THEN 'no split/bonus/dividend keyword in subject'
 WHEN coalesce(ratio, dividend, 0) = 0 THEN type || ': could not parse value from subject' END AS reason FROM (
 SELECT *, CASE type WHEN 'split' THEN coalesce(fn/fo, ra/rb) WHEN 'bonus' THEN rb/(ra + rb) END AS ratio,
 CASE WHEN type = 'dividend' THEN CASE WHEN len(amts) > 0 THEN list_sum(amts) WHEN face > 0 THEN pct/100.0*face END END AS dividend FROM ca_typed)""")
query("f01_classify_action", "ca_typed", "SELECT subject, type, count(*) AS n FROM ca_typed GROUP BY 1, 2")(
    lambda v: feed(v).select("subject", text.classify_action(c("subject")).alias("type")).groupBy("subject", "type").agg(F.count("*").alias("n")))
query("f02_split_multiplier", "ca_typed", f"SELECT DISTINCT subject, {rnd('coalesce(fn/fo, ra/rb)')} AS ratio FROM ca_typed WHERE type = 'split'")(
    lambda v: feed(v).filter(text.classify_action(c("subject")) == "split").select("subject", text.split_multiplier(c("subject")).alias("ratio")).distinct())
query("f03_bonus_multiplier", "ca_typed", f"SELECT DISTINCT subject, {rnd('rb/(ra + rb)')} AS ratio FROM ca_typed WHERE type = 'bonus'")(
    lambda v: feed(v).filter(text.classify_action(c("subject")) == "bonus").select("subject", text.bonus_multiplier(c("subject")).alias("ratio")).distinct())
query("f04_dividend_amount", "ca_typed", f"SELECT DISTINCT subject, face_value, {rnd('CASE WHEN len(amts) > 0 THEN list_sum(amts) WHEN face > 0 THEN pct/100.0*face END')} AS dividend FROM ca_typed WHERE type = 'dividend'")(
    lambda v: feed(v).filter(text.classify_action(c("subject")) == "dividend").select(
        "subject", "face_value", text.dividend_amount(c("subject"), c("face_value").try_cast("double")).alias("dividend")).distinct())
query("f05_corporate_action_events", "ca_parsed", f"SELECT DISTINCT ON (isin, strptime(ex_date_raw, '%d-%b-%Y'), type, ratio, dividend) isin, symbol, CAST(CAST(strptime(ex_date_raw, '%d-%b-%Y') AS DATE) AS VARCHAR) AS ex_date, type, {rounded('ratio dividend')} FROM ca_parsed WHERE reason IS NULL")(
    lambda v: adjust.parse_corporate_actions(feed(v))[0].drop("subject"))
query("f05_corporate_action_rejects", "ca_parsed", "SELECT isin, symbol, ex_date_raw, subject, reason FROM ca_parsed WHERE reason IS NOT NULL")(
    lambda v: adjust.parse_corporate_actions(feed(v))[1])
query("u02_event_dedup", "ca_parsed", "SELECT type, CAST(sum(n) AS BIGINT) AS kept FROM (SELECT type, 1 AS n FROM ca_parsed WHERE reason IS NULL GROUP BY isin, ex_date_raw, type, ratio, dividend) GROUP BY type")(
    lambda v: adjust.parse_corporate_actions(feed(v).unionByName(feed(v)))[0].groupBy("type").agg(F.count("*").alias("kept")))
query("j10_back_factors", "adjusted", f"SELECT isin, {DATE}, {rounded('adj_factor tr_factor')} FROM adjusted")(
    lambda v: adjust.back_factors(v.legs, adjust.assign_events(v.legs, v.corp_actions)))
query("j11_dividend_multipliers", "ev_mult", f"SELECT isin, CAST(ex_date AS VARCHAR) AS ex_date, {rounded('prior_close')}, {rnd('tot')} AS multiplier FROM ev_mult WHERE type = 'dividend' AND tot IS NOT NULL")(
    lambda v: adjust.dividend_multipliers(v.legs, adjust.assign_events(v.legs, v.corp_actions)))
query("w12_adv_20", "adjusted", f"SELECT isin, {DATE}, {rnd('adv_20')} AS adv_20 FROM adjusted")(lambda v: v.adjusted.select("isin", "date", "adv_20"))
query("a08_symbol_map", "lifetimes", "SELECT isin, symbol, CAST(first_date AS VARCHAR) AS first_date, CAST(last_date AS VARCHAR) AS last_date FROM lifetimes")(
    lambda v: identity.universe(v.adjusted)[2])
query("u01_membership", "legs", f"SELECT DISTINCT isin, {DATE} FROM legs")(lambda v: identity.universe(v.adjusted)[1])

# --- identity ----------------------------------------------------------------
cte("pairs", "lifetimes legs events_ca", """
SELECT *, CASE WHEN asserted THEN old_isin ELSE '' END AS root_isin FROM (SELECT *, signals_matched >= 2 AS asserted FROM (
 SELECT *, CAST(sig_consecutive AS INTEGER) + CAST(sig_prefix AS INTEGER) + CAST(sig_ca_split AS INTEGER) AS signals_matched FROM (
 SELECT p.*, coalesce((SELECT min(date) FROM legs WHERE date > old_last) = new_first, false) AS sig_consecutive,
  left(old_isin, 9) = left(new_isin, 9) AND CAST(substr(new_isin, 10, 2) AS INTEGER) > CAST(substr(old_isin, 10, 2) AS INTEGER) AS sig_prefix,
  EXISTS (SELECT 1 FROM events_ca e WHERE e.type = 'split' AND e.isin = old_isin AND e.ex_date BETWEEN old_last - 15 AND new_first + 15) AS sig_ca_split
 FROM (SELECT symbol, isin AS old_isin, last_date AS old_last, lead(isin) OVER w AS new_isin, lead(first_date) OVER w AS new_first FROM lifetimes WINDOW w AS (PARTITION BY symbol ORDER BY first_date)) p WHERE new_isin IS NOT NULL)))""")
SIGS = "sig_consecutive, sig_prefix, sig_ca_split, signals_matched, asserted"
cals = lambda v: calendar.trading_days(v.bars)


def pairs_of(v):
    return identity.successor_map(v.lifetimes, v.corp_actions, cals(v), identity.last_state(v.adjusted.withColumn("instrument_id", c("isin"))).select("isin", "adv_last"), LIQUIDITY_FLOOR)


query("w31_candidate_pairs", "pairs", "SELECT symbol, old_isin, new_isin, CAST(old_last AS VARCHAR) AS old_last, CAST(new_first AS VARCHAR) AS new_first FROM pairs")(
    lambda v: identity.candidate_pairs(v.lifetimes))
query("j14_consecutive_legs", "pairs", "SELECT old_isin, new_isin, sig_consecutive FROM pairs")(
    lambda v: identity.flag_consecutive(identity.candidate_pairs(v.lifetimes), cals(v)).select("old_isin", "new_isin", "sig_consecutive"))
query("j13_split_near_transition", "pairs", "SELECT old_isin, new_isin, sig_ca_split FROM pairs")(
    lambda v: identity.flag_ca_split(identity.candidate_pairs(v.lifetimes), v.corp_actions).select("old_isin", "new_isin", "sig_ca_split"))
query("f06_isin_prefix", "pairs", "SELECT old_isin, new_isin, sig_prefix FROM pairs")(
    lambda v: identity.candidate_pairs(v.lifetimes).select("old_isin", "new_isin", identity.prefix_increments(c("old_isin"), c("new_isin")).alias("sig_prefix")))
query("u10_successor_map", "pairs adjusted", f"""
SELECT symbol, old_isin, new_isin, {SIGS}, root_isin, a.adv >= {LIQUIDITY_FLOOR} AS liquid_old_leg FROM pairs
 JOIN (SELECT isin, arg_max(adv_20, date) AS adv FROM adjusted GROUP BY isin) a ON a.isin = old_isin""")(
    lambda v: pairs_of(v).select("symbol", "old_isin", "new_isin", "sig_consecutive", "sig_prefix", "sig_ca_split", "signals_matched", "asserted", "root_isin", "liquid_old_leg"))
query("u10_successor_unmatched", "pairs", "SELECT symbol, old_isin, new_isin, signals_matched, 'only ' || CAST(signals_matched AS VARCHAR) || ' signal(s) (need >= 2)' AS reason FROM pairs WHERE NOT asserted")(
    lambda v: identity.unmatched(pairs_of(v)))


def forked(v):
    edges = v.bars.groupBy("symbol").agg(F.count("*").alias("n")).select(
        F.concat(F.lit("A"), (c("symbol") % 7).cast("string")).alias("old_isin"),
        F.concat(F.lit("B"), c("symbol").cast("string")).alias("new_isin"), (c("n") % 4 != 0).alias("asserted"))
    return identity.fork_guard(edges)


query("u05_fork_guard", "bars", """
SELECT old_isin, new_isin, ok AND NOT dup AS asserted, dup AS conflict FROM (SELECT *, ok AND sum(CAST(ok AS INTEGER)) OVER (PARTITION BY old_isin) > 1 AS dup FROM (
 SELECT 'A' || CAST(symbol % 7 AS VARCHAR) AS old_isin, 'B' || CAST(symbol AS VARCHAR) AS new_isin, count(*) % 4 <> 0 AS ok FROM bars GROUP BY symbol))""")(forked)


def chains(v):
    edges = v.stocks.filter(c("symbol") % 5 != 4).select(
        F.format_string("X%06d", c("symbol")).alias("old_isin"), F.format_string("X%06d", c("symbol") + 1).alias("new_isin"))
    return identity.chain_roots(edges)


query("w32_chain_roots", "stocks", """
WITH e AS (SELECT symbol AS s FROM stocks WHERE symbol % 5 <> 4), i AS (SELECT s FROM e UNION SELECT s + 1 FROM e)
SELECT 'X' || lpad(CAST(s AS VARCHAR), 6, '0') AS isin, 'X' || lpad(CAST(s - s % 5 AS VARCHAR), 6, '0') AS root FROM i""")(chains)
query("j20_collapsed_identity", "adjusted pairs", f"""
SELECT a.isin, {DATE}, coalesce(p.root_isin, a.isin) AS instrument_id FROM adjusted a LEFT JOIN (
 SELECT old_isin AS isin, root_isin FROM pairs WHERE asserted UNION SELECT new_isin, root_isin FROM pairs WHERE asserted) p USING (isin)""")(
    lambda v: identity.collapse_identity(v.adjusted, pairs_of(v)).select("isin", "date", "instrument_id"))


def rederived(v):
    path = storage.scratch_path(v.spark, "rederived")
    storage.write_by_year(identity.with_instrument_id(v.adjusted, pairs_of(v)), path, "instrument_id")
    out = v.spark.read.parquet(path)
    return out.agg(F.count("*").alias("rows"), F.countDistinct("isin").alias("isins"), F.countDistinct("instrument_id").alias("instruments"))


query("s18_rederived_ids", "legs pairs", "SELECT (SELECT count(*) FROM legs) AS rows, (SELECT count(DISTINCT isin) FROM legs) AS isins, (SELECT count(DISTINCT isin) FROM legs) - (SELECT count(*) FROM pairs WHERE asserted) AS instruments")(rederived)
cte("ident", "adjusted pairs", """SELECT a.*, coalesce(p.root_isin, a.isin) AS instrument_id FROM adjusted a LEFT JOIN (
 SELECT old_isin AS isin, root_isin FROM pairs WHERE asserted UNION SELECT new_isin, root_isin FROM pairs WHERE asserted) p USING (isin)""")
cte("termset", "ident pairs", f"""
SELECT *, CASE WHEN days_before_edge <= 60 AND cluster_size >= 5 THEN 'data_gap_suspect' WHEN upper(CAST(symbol AS VARCHAR)) LIKE '%DVR' THEN 'cancellation'
 WHEN last_peak_ratio < 0.5 THEN 'delisting_insolvency' ELSE 'merger' END AS subtype FROM (
 SELECT *, count(*) OVER (PARTITION BY last_date) AS cluster_size, edge - last_date AS days_before_edge FROM (
  SELECT isin, arg_max(symbol, date) AS symbol, max(date) AS last_date, arg_max(instrument_id, date) AS instrument_id, arg_max(adv_20, date) AS adv_last,
   arg_max(close_raw, date)/max(close_raw) AS last_peak_ratio, (SELECT max(date) FROM ident) AS edge FROM ident GROUP BY isin) WHERE last_date < edge - 15)
WHERE isin NOT IN (SELECT old_isin FROM pairs WHERE asserted) AND adv_last >= {LIQUIDITY_FLOOR / 4}
 AND instrument_id NOT IN (SELECT instrument_id FROM ident WHERE date >= (SELECT max(date) FROM ident) - 15)""")
KW = dict(liquidity_floor=LIQUIDITY_FLOOR / 4)


def ident_of(v):
    pairs = pairs_of(v)
    return identity.with_instrument_id(v.adjusted, pairs), pairs


query("j15_terminations", "termset", f"SELECT isin, symbol, instrument_id, CAST(last_date AS VARCHAR) AS last_date, {rounded('adv_last last_peak_ratio')}, days_before_edge, cluster_size FROM termset")(
    lambda v: identity.terminations(*ident_of(v), **KW).select("isin", "symbol", "instrument_id", "last_date", "adv_last", "last_peak_ratio", "days_before_edge", "cluster_size"))
query("p24_termination_kind", "termset", "SELECT isin, CASE WHEN isin LIKE '%0000010' THEN 'curated_merger' ELSE subtype END AS subtype, CASE WHEN isin LIKE '%0000010' THEN 'curated' ELSE 'heuristic' END AS confidence FROM termset")(
    lambda v: identity.terminations(*ident_of(v), v.lifetimes.filter(c("isin").endswith("0000010")).select("isin", F.lit("curated_merger").alias("fate")), **KW).select("isin", "subtype", "confidence"))
query("w40_silent_days", "ident", """
WITH d AS (SELECT date, row_number() OVER (ORDER BY date) AS o FROM (SELECT DISTINCT date FROM ident))
SELECT instrument_id, CAST(date AS VARCHAR) AS last_date, (SELECT max(o) FROM d) - o AS silent_days FROM (SELECT instrument_id, max(date) AS date FROM ident GROUP BY 1) JOIN d USING (date)""")(
    lambda v: identity.silent_days(ident_of(v)[0]))
query("w40_silence_by_day", "legs", f"""
WITH d AS (SELECT date, row_number() OVER (ORDER BY date) AS o FROM (SELECT DISTINCT date FROM legs))
SELECT isin, {DATE}, o - lag(o) OVER (PARTITION BY isin ORDER BY date) AS silent_days FROM legs JOIN d USING (date)""")(
    lambda v: identity.silence_by_day(v.legs))
query("w41_factor_steps", "adjusted", f"""
SELECT isin, {DATE}, {rnd('step')} AS step FROM (SELECT *, adj_factor/lag(adj_factor) OVER (PARTITION BY isin ORDER BY date) AS step FROM adjusted) WHERE abs(step - 1) > 0.05""")(
    lambda v: fundamentals.factor_steps(v.adjusted))

# --- store checks --------------------------------------------------------------
query("q01_known_events", "ev_assigned adjusted", f"""
SELECT isin, CAST(ex_date AS VARCHAR) AS ex_date, {rnd('abs(c1 - c0)/c0')} AS gap, {rnd('f0/f1')} AS ratio,
 abs(c1 - c0)/c0 > 0.4 OR (abs(f0 - f1) > 1e-6*f1 + 1e-8 AND abs(f0/f1 - 0.5) > 0.02) AS failed FROM (
 SELECT e.isin, e.ex_date, b.close AS c0, b.adj_factor AS f0, a.close AS c1, a.adj_factor AS f1 FROM (SELECT * FROM ev_assigned WHERE type <> 'dividend') e
 ASOF JOIN adjusted b ON b.isin = e.isin AND e.ex_date > b.date ASOF JOIN adjusted a ON a.isin = e.isin AND e.ex_date <= a.date)""")(
    lambda v: quality.known_events(v.adjusted, adjust.assign_events(v.legs, v.corp_actions).filter("type <> 'dividend'").select(
        "isin", "ex_date", F.lit(0.5).alias("expected"), F.lit(0.02).alias("tol"))))
query("q02_survivorship", "lifetimes", """
SELECT count(*) AS ids, count(*) FILTER (WHERE DATE '2001-08-01' - l > 365) AS delisted, count(*) FILTER (WHERE DATE '2001-08-01' - l > 365) = 0 AS failed
FROM (SELECT isin, max(last_date) AS l FROM lifetimes GROUP BY isin)""")(
    lambda v: quality.survivorship(v.lifetimes, F.lit("2001-08-01").cast("date")))
query("q03_rename_overlap", "lifetimes", """
SELECT isin, symbol, nf <= last_date AS failed FROM (SELECT *, lead(first_date) OVER (PARTITION BY isin ORDER BY first_date, symbol) AS nf FROM (
 SELECT isin, symbol, first_date, last_date FROM lifetimes UNION ALL SELECT isin, symbol + 100000, last_date + CAST(symbol % 3 AS INTEGER), last_date + 10 FROM lifetimes)) WHERE nf IS NOT NULL""")(
    lambda v: quality.rename_overlap(v.lifetimes.unionByName(v.lifetimes.select(
        "isin", (c("symbol") + 100000).alias("symbol"), F.date_add("last_date", (c("symbol") % 3).cast("int")).alias("first_date"), F.date_add("last_date", 10).alias("last_date")))))
query("q04_causal_adv", "adjusted", f"""
SELECT isin, {DATE}, day(date) = 1 AS failed FROM adjusted""")(
    lambda v: quality.causal_adv(v.adjusted.withColumn("adv_20", F.when(F.dayofmonth("date") == 1, c("adv_20") * 1.5).otherwise(c("adv_20")))))
query("q05_total_return_growth", "adjusted", f"""
SELECT isin, {rounded('price_growth tr_growth')}, tr_growth < price_growth - 1e-6 AS failed FROM (SELECT isin, count(*) AS n, arg_max(close, date)/arg_min(close, date) AS price_growth,
 arg_max(close_tr, date)/arg_min(close_tr, date) AS tr_growth FROM adjusted GROUP BY isin) WHERE n >= 2""")(
    lambda v: quality.total_return_growth(v.adjusted))


def unadjusted(v):
    return v.adjusted.withColumn("close", F.when(F.dayofmonth("date") == 15, c("close") / 2).otherwise(c("close")))


query("q06_unadjusted_actions", "adjusted", f"""
SELECT isin, {DATE}, {rnd('ratio')} AS ratio, coalesce(flat AND (abs(ratio - 0.5) <= 0.05 OR abs(ratio - 1.0/3) <= 0.1/3 OR abs(ratio - 0.25) <= 0.025 OR abs(ratio - 0.2) <= 0.02 OR abs(ratio - 0.1) <= 0.01), false) AS failed
FROM (SELECT isin, date, close/lag(close) OVER w AS ratio, abs(adj_factor - lag(adj_factor) OVER w) <= 1e-8 + 1e-6*lag(adj_factor) OVER w
 AND abs(tr_factor - lag(tr_factor) OVER w) <= 1e-8 + 1e-6*lag(tr_factor) OVER w AS flat FROM (SELECT * REPLACE (CASE WHEN day(date) = 15 THEN close/2 ELSE close END AS close) FROM adjusted)
 WINDOW w AS (PARTITION BY isin ORDER BY date)) WHERE ratio IS NOT NULL""")(lambda v: quality.unadjusted_actions(unadjusted(v)))
query("q07_succession_coverage", "pairs", "SELECT old_isin, new_isin, root_isin, false AS failed FROM pairs WHERE asserted")(
    lambda v: quality.succession_coverage(ident_of(v)[1], ident_of(v)[0]))
query("q08_silent_terminations", "termset ident", """
WITH d AS (SELECT date, row_number() OVER (ORDER BY date) AS o FROM (SELECT DISTINCT date FROM ident))
SELECT isin, (SELECT max(o) FROM d) - o AS silent_days, (SELECT max(o) FROM d) - o < 5 AS failed FROM termset t JOIN (SELECT instrument_id, max(date) AS date FROM ident GROUP BY 1) l USING (instrument_id) JOIN d USING (date)
WHERE subtype <> 'data_gap_suspect'""")(lambda v: quality.silent_terminations(*ident_of(v), **KW))
query("j19_drift_guard", "adjusted", """
SELECT isin, n AS drifted_rows, e AS explained, n > 0 AND NOT e AS failed FROM (SELECT isin, count(*) FILTER (WHERE symbol % 4 = 1 AND close <> 0) AS n, any_value(symbol) % 8 = 1 AS e FROM adjusted GROUP BY isin)""")(
    lambda v: quality.drift_guard(v.adjusted, v.adjusted.withColumn("close", F.when(c("symbol") % 4 == 1, c("close") * 1.01).otherwise(c("close"))),
                                  v.adjusted.filter(c("symbol") % 8 == 1)))
query("a44_store_coverage", "adjusted", f"""
SELECT count(*) AS rows, count(DISTINCT isin) AS ids, CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date,
 (SELECT count(*) FROM (SELECT isin, max(date) AS m FROM adjusted GROUP BY isin) WHERE (SELECT max(date) FROM adjusted) - m > 365) AS delisted,
 (SELECT {rnd('count(*) FILTER (WHERE d NOT IN (SELECT date FROM adjusted))*100.0/count(*)')} FROM (SELECT CAST(unnest(generate_series((SELECT min(date) FROM adjusted), (SELECT max(date) FROM adjusted), INTERVAL 1 DAY)) AS DATE) AS d) WHERE isodow(d) < 6) AS missing_weekday_pct FROM adjusted""")(
    lambda v: quality.store_coverage(v.adjusted))

# --- scalars and calendars -----------------------------------------------------
query("f07_ticker", "stocks", """
SELECT symbol, CASE WHEN symbol % 10 = 0 THEN '^N' || CAST(symbol AS VARCHAR) WHEN symbol % 10 = 1 THEN 'X' || CAST(symbol AS VARCHAR) || '.NS'
 WHEN symbol % 10 = 2 THEN 'NEWNAME.NS' ELSE 'S' || CAST(symbol AS VARCHAR) || '.NS' END AS ticker FROM stocks""")(
    lambda v: v.stocks.select("symbol", text.normalise_ticker(
        F.when(c("symbol") % 10 == 0, F.concat(F.lit(" ^n"), c("symbol").cast("string"))).when(c("symbol") % 10 == 1, F.concat(F.lit("x"), c("symbol").cast("string"), F.lit(".ns")))
        .when(c("symbol") % 10 == 2, F.lit("oldname")).otherwise(F.concat(F.lit("s"), c("symbol").cast("string"), F.lit(" "))), {"OLDNAME": "NEWNAME"}).alias("ticker")))
RAWNUM = "CASE o_orderkey % 6 WHEN 0 THEN 'nan' WHEN 1 THEN 'inf' WHEN 2 THEN 'abc' WHEN 3 THEN NULL WHEN 4 THEN '-inf' ELSE CAST(o_custkey AS STRING) END"
query("f08_safe_cast", "", f"""
SELECT o_orderkey, {rnd('CASE WHEN o_orderkey % 6 = 5 THEN o_custkey ELSE -1.0 END')} AS f, CASE WHEN o_orderkey % 6 = 5 THEN o_custkey ELSE 0 END AS i, o_orderstatus = 'O' AS b FROM orders""")(
    lambda v: v.table("orders").select("o_orderkey", text.safe_double(F.expr(RAWNUM), -1.0).alias("f"), text.safe_long(F.expr(RAWNUM), 0).alias("i"),
                                       text.safe_bool(F.when(c("o_orderstatus") == "O", "true").when(c("o_orderstatus") == "F", "x")).alias("b")))
WEEKLY = "date + CAST((5 - isodow(date) + 7) % 7 AS INTEGER)"
for cad, g in (("weekly", WEEKLY), ("monthly", "date_trunc('month', date)"), ("quarterly", "date_trunc('quarter', date)"),
               ("half-yearly", "year(date)*10 + CASE WHEN month(date) <= 6 THEN 1 ELSE 2 END")):
    query(f"w30_anchors_{cad.replace('-', '_')}", "bars", f"SELECT CAST(max(date) AS VARCHAR) AS date FROM bars GROUP BY {g}")(
        lambda v, cad=cad: calendar.anchors(cals(v), cad))
cte("reviews", "bars", """
SELECT DISTINCT (SELECT max(date) FROM bars WHERE date <= a) AS date FROM (SELECT unnest([make_date(y, 1, 31), make_date(y, 7, 31)]) AS a FROM range(1990, 2020) t(y))
WHERE a BETWEEN (SELECT min(date) FROM bars) AND (SELECT max(date) FROM bars)""")
query("w30_review_days", "reviews", f"SELECT {DATE} FROM reviews")(lambda v: calendar.review_days(cals(v)))
query("j32_nearest_day", "bars", """
WITH c AS (SELECT DISTINCT date AS d FROM bars WHERE day(date) % 3 = 0), w AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS wanted FROM orders)
SELECT CAST(wanted AS VARCHAR) AS wanted, CAST(CASE WHEN f IS NULL OR wanted - b <= f - wanted THEN b ELSE f END AS VARCHAR) AS date FROM (
 SELECT wanted, (SELECT max(d) FROM c WHERE d <= wanted) AS b, (SELECT min(d) FROM c WHERE d >= wanted) AS f FROM w) WHERE b IS NOT NULL OR f IS NOT NULL""".replace(
    "CASE WHEN f IS NULL OR", "CASE WHEN b IS NULL THEN f WHEN f IS NULL OR"))(
    lambda v: calendar.nearest_day(v.table("orders").select(F.to_date("o_orderdate").alias("wanted")).distinct(), cals(v).filter(F.dayofmonth("date") % 3 == 0)))
ORD = "SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders"
odays = lambda v: v.table("orders").select(F.to_date("o_orderdate").alias("d")).distinct()
ROLL = "CASE isodow(d) WHEN 6 THEN d + 2 WHEN 7 THEN d + 1 ELSE d END"
query("f24_roll_forward", "", f"SELECT CAST(d AS VARCHAR) AS d, CAST({ROLL} AS VARCHAR) AS rolled FROM ({ORD})")(
    lambda v: odays(v).select("d", calendar.roll_forward(c("d")).alias("rolled")))
query("f22_asof_cutoff", "", f"SELECT CAST(r AS VARCHAR) AS d, CAST(r - CASE WHEN isodow(r) <= 2 THEN 4 ELSE 2 END AS VARCHAR) AS cutoff FROM (SELECT DISTINCT {ROLL} AS r FROM ({ORD}))")(
    lambda v: odays(v).select(calendar.roll_forward(c("d")).alias("d")).distinct().select("d", calendar.minus_two_business_days(c("d")).alias("cutoff")))
query("f23_weekday_lag", "", f"""
SELECT CAST(d AS VARCHAR) AS d, (SELECT count(*) FROM range(1, 15) t(k) WHERE k <= 14 AND isodow(d + CAST(k AS INTEGER)) < 6 AND k <= day(d) % 15) AS lag FROM ({ORD})""")(
    lambda v: odays(v).select("d", calendar.weekday_lag(c("d"), F.date_add("d", F.dayofmonth("d") % 15)).alias("lag")))
query("f25_months_elapsed", "", f"SELECT CAST(d AS VARCHAR) AS d, {rnd('(2001 - year(d))*12 + (8 - month(d)) + (1 - day(d))/30.0')} AS months FROM ({ORD})")(
    lambda v: odays(v).select("d", calendar.months_elapsed(c("d"), F.lit("2001-08-01").cast("date")).alias("months")))
query("u03_unknown_ids", "", "SELECT DISTINCT o_custkey % 130 AS id FROM orders WHERE o_custkey % 130 NOT IN (SELECT s_suppkey FROM supplier)")(
    lambda v: v.table("orders").select((c("o_custkey") % 130).alias("id")).distinct().join(
        v.table("supplier").select(c("s_suppkey").alias("id")), "id", "left_anti"))
query("u04_missing_days", "bars", f"SELECT {DATE} FROM (SELECT DISTINCT date FROM bars) WHERE date NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders)")(
    lambda v: cals(v).join(v.nav.select("date"), "date", "left_anti"))
query("u07_known_delistings", "lifetimes", "SELECT DISTINCT 'INE' || lpad(CAST(s_suppkey AS VARCHAR), greatest(6, length(CAST(s_suppkey AS VARCHAR)))::INTEGER, '0') || '020' AS isin FROM supplier WHERE s_suppkey % 10 <> 0")(
    lambda v: fundamentals.missing_delistings(
        v.stocks.select(F.concat(F.lit("INE"), padded(c("symbol")), F.lit("020")).alias("isin")), v.lifetimes))
query("u09_common_days", "bars nav", f"SELECT {DATE} FROM (SELECT date FROM bars INTERSECT SELECT date FROM nav)")(
    lambda v: cals(v).intersect(v.nav.select("date")))
