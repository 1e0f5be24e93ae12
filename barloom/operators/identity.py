"""Instrument identity: succession between ids, chain roots, terminations, universe."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.windows import one_series, rolling_median, sure
from barloom.sources.storage import cut_lineage

c = F.col
MIN_SIGNALS = 2
SPLIT_WINDOW_DAYS = 15
PAIR = ("symbol", "old_isin", "new_isin", "old_last", "new_first")


def candidate_pairs(lifetimes: DataFrame) -> DataFrame:
    """Each id of a symbol with the one that starts next."""
    w = Window.partitionBy("symbol").orderBy("first_date", "isin")
    nxt = F.lead(F.struct("isin", "first_date")).over(w)
    return lifetimes.withColumn("_n", nxt).filter(c("_n").isNotNull()).select(
        "symbol",
        c("isin").alias("old_isin"),
        c("_n.isin").alias("new_isin"),
        c("last_date").alias("old_last"),
        c("_n.first_date").alias("new_first"),
    )


def next_trading_day(calendar: DataFrame) -> DataFrame:
    """(date, next_day); calendar has one row per day."""
    return calendar.select("date", F.lead("date").over(one_series()).alias("next_day"))


def flag_consecutive(pairs: DataFrame, calendar: DataFrame) -> DataFrame:
    nxt = next_trading_day(calendar).withColumnRenamed("date", "old_last")
    return pairs.join(nxt, "old_last", "left").withColumn(
        "sig_consecutive", sure(c("next_day") == c("new_first"))
    ).drop("next_day")


def prefix_increments(old, new):
    """Same 9-character issuer prefix and a larger two-digit suffix."""
    suffix = lambda x: F.substring(x, 10, 2).try_cast("int")
    return sure(
        (F.length(old) == 12)
        & (F.length(new) == 12)
        & (F.substring(old, 1, 9) == F.substring(new, 1, 9))
        & (suffix(new) > suffix(old))
    )


def flag_ca_split(pairs: DataFrame, events: DataFrame, days: int = SPLIT_WINDOW_DAYS) -> DataFrame:
    """True where a split is filed under the old id near the transition."""
    splits = events.filter(c("type") == "split").select(c("isin").alias("old_isin"), "ex_date")
    hits = (
        pairs.select("old_isin", "new_isin", "old_last", "new_first")
        .join(splits, "old_isin")
        .filter(c("ex_date").between(F.date_sub("old_last", days), F.date_add("new_first", days)))
        .select("old_isin", "new_isin", F.lit(True).alias("sig_ca_split"))
        .distinct()
    )
    return pairs.join(hits, ["old_isin", "new_isin"], "left").withColumn("sig_ca_split", sure(c("sig_ca_split")))


def fork_guard(pairs: DataFrame) -> DataFrame:
    """An id in two asserted edges on the same side makes both ambiguous."""
    out = pairs
    for side in ("old_isin", "new_isin"):
        n = F.sum(c("asserted").cast("int")).over(Window.partitionBy(side))
        out = out.withColumn(f"_dup_{side}", c("asserted") & (n > 1))
    return (
        out.withColumn("conflict", c("_dup_old_isin") | c("_dup_new_isin"))
        .withColumn("asserted", c("asserted") & ~c("conflict"))
        .drop("_dup_old_isin", "_dup_new_isin")
    )


def chain_roots(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Oldest id of each chain of (old_isin, new_isin) edges, by pointer doubling.

    The edges form simple paths (see :func:`fork_guard`), so each round doubles the
    hop length; the state is checkpointed, since rounds depend on data.
    """
    ids = edges.select(c("old_isin").alias("isin")).union(edges.select("new_isin")).distinct()
    parent = edges.select(c("new_isin").alias("isin"), c("old_isin").alias("root"))
    state = cut_lineage(ids.join(parent, "isin", "left").select("isin", F.coalesce("root", "isin").alias("root")))
    for _ in range(max_rounds):
        up = state.select(c("isin").alias("root"), c("root").alias("_up"))
        step = cut_lineage(
            state.join(up, "root").select("isin", c("_up").alias("root"), (c("_up") != c("root")).alias("_moved"))
        )
        moved = step.filter("_moved").limit(1).count()
        state = step.drop("_moved")
        if not moved:
            looped = state.join(parent.select(c("isin").alias("root")), "root", "left_semi").limit(1).count()
            if looped:
                break
            return state
    raise ValueError("succession edges contain a cycle")


def successor_map(lifetimes: DataFrame, events: DataFrame, calendar: DataFrame, old_adv: DataFrame | None = None,
                  liquid_floor: float = 5e7) -> DataFrame:
    """Every candidate link with its three signals, verdict, conflict flag and chain root."""
    pairs = flag_ca_split(flag_consecutive(candidate_pairs(lifetimes), calendar), events)
    pairs = pairs.withColumn("sig_prefix", prefix_increments(c("old_isin"), c("new_isin")))
    matched = sum(c(s).cast("int") for s in ("sig_consecutive", "sig_prefix", "sig_ca_split"))
    pairs = fork_guard(
        pairs.withColumn("signals_matched", matched).withColumn("asserted", c("signals_matched") >= MIN_SIGNALS)
    )
    pairs = cut_lineage(pairs)
    roots = chain_roots(pairs.filter("asserted")).select(c("isin").alias("old_isin"), c("root").alias("root_isin"))
    out = pairs.join(roots, "old_isin", "left").withColumn(
        "root_isin", F.when(c("asserted"), c("root_isin")).otherwise(F.lit(""))
    )
    if old_adv is None:
        return out.withColumn("liquid_old_leg", F.lit(False))
    adv = old_adv.select(c("isin").alias("old_isin"), "adv_last")
    return out.join(adv, "old_isin", "left").withColumn(
        "liquid_old_leg", F.coalesce(c("adv_last"), F.lit(0.0)) >= liquid_floor
    ).drop("adv_last")


def unmatched(pairs: DataFrame) -> DataFrame:
    reason = F.when(c("conflict"), "conflict: ambiguous successor (fork)").otherwise(
        F.concat(F.lit("only "), c("signals_matched").cast("string"), F.lit(f" signal(s) (need >= {MIN_SIGNALS})"))
    )
    return pairs.filter(~c("asserted")).select("symbol", "old_isin", "new_isin", "signals_matched", reason.alias("reason"))


def with_instrument_id(prices: DataFrame, pairs: DataFrame) -> DataFrame:
    """Chain root as the id of every row; an id outside chains stands for itself."""
    edges = pairs.filter("asserted")
    roots = (
        edges.select(c("old_isin").alias("isin"), "root_isin")
        .union(edges.select("new_isin", "root_isin"))
        .distinct()
    )
    return prices.drop("instrument_id").join(roots, "isin", "left").withColumn(
        "instrument_id", F.coalesce("root_isin", "isin")
    ).drop("root_isin")


def collapse_identity(prices: DataFrame, pairs: DataFrame) -> DataFrame:
    """Prices keyed by chain root; two rows on one (root, date) raise."""
    out = with_instrument_id(prices, pairs)
    n = F.count("*").over(Window.partitionBy("instrument_id", "date"))
    guarded = F.when(n > 1, F.raise_error(F.lit("overlapping legs in one chain"))).otherwise(c("instrument_id"))
    return out.withColumn("_n", n).withColumn(
        "instrument_id", F.when(c("_n") > 1, guarded).otherwise(c("instrument_id"))
    ).drop("_n")


def universe(adjusted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Prices with adv_20, distinct (isin, date) membership, and the symbol map."""
    prices = adjusted.withColumn("adv_20", rolling_median(c("traded_value"), 20, ["isin"]))
    membership = adjusted.select("isin", "date").distinct()
    symbols = adjusted.groupBy("isin", "symbol").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )
    return prices, membership, symbols


def last_state(prices: DataFrame) -> DataFrame:
    """Closing state of each id: last row's measures and the peak close."""
    return prices.groupBy("isin").agg(
        F.max_by("symbol", "date").alias("symbol"),
        F.max("date").alias("last_date"),
        F.max_by("instrument_id", "date").alias("instrument_id"),
        F.max_by("adv_20", "date").alias("adv_last"),
        (F.max_by("close_raw", "date") / F.max("close_raw")).alias("last_peak_ratio"),
    )


def terminations(prices: DataFrame, pairs: DataFrame, fates: DataFrame | None = None, *, liquidity_floor: float,
                 cutoff_days: int = 15, near_edge_days: int = 60, min_cluster: int = 5,
                 insolvent_ratio: float = 0.5) -> DataFrame:
    """Ids that stopped trading without a successor, liquid at the end, with their kind."""
    edge = prices.agg(F.max("date")).scalar()
    life = last_state(prices)
    alive = life.filter(c("last_date") >= F.date_sub(edge, cutoff_days)).select("instrument_id").distinct()
    gone = life.filter(c("last_date") < F.date_sub(edge, cutoff_days)).withColumn(
        "cluster_size", F.count("*").over(Window.partitionBy("last_date"))
    )
    old = pairs.filter("asserted").select(c("old_isin").alias("isin"))
    gone = (
        gone.join(old, "isin", "left_anti")
        .join(alive, "instrument_id", "left_anti")
        .filter(c("adv_last") >= liquidity_floor)
        .withColumn("days_before_edge", F.datediff(edge, c("last_date")))
    )
    if fates is None:
        gone = gone.withColumn("fate", F.lit(None).cast("string"))
    else:
        gone = gone.join(fates.select("isin", "fate"), "isin", "left")
    return gone.withColumn("subtype", termination_kind(near_edge_days, min_cluster, insolvent_ratio)).withColumn(
        "confidence", F.when(c("fate").isNotNull(), "curated").otherwise("heuristic")
    )


def termination_kind(near_edge_days: int, min_cluster: int, insolvent_ratio: float):
    """Curated fate, then ingest gap, differential-voting suffix, destroyed value, merger."""
    return F.coalesce(
        c("fate"),
        F.when((c("days_before_edge") <= near_edge_days) & (c("cluster_size") >= min_cluster), "data_gap_suspect")
        .when(F.upper(c("symbol").cast("string")).endswith("DVR"), "cancellation")
        .when(c("last_peak_ratio") < insolvent_ratio, "delisting_insolvency")
        .otherwise("merger"),
    )


def silent_days(prices: DataFrame) -> DataFrame:
    """Trading days between each instrument's last print and the last market day."""
    days = prices.select("date").distinct().withColumn("_ord", F.row_number().over(one_series()))
    edge = days.agg(F.max("_ord")).scalar()
    last = prices.groupBy("instrument_id").agg(F.max("date").alias("date"))
    return last.join(days, "date").select("instrument_id", c("date").alias("last_date"), (edge - c("_ord")).alias("silent_days"))


def silence_by_day(prices: DataFrame) -> DataFrame:
    """Per print, the market days since the instrument's previous print."""
    days = prices.select("date").distinct().withColumn("_ord", F.row_number().over(one_series()))
    w = Window.partitionBy("isin").orderBy("date")
    return prices.select("isin", "date").join(days, "date").select(
        "isin", "date", (c("_ord") - F.lag("_ord").over(w)).alias("silent_days")
    )
