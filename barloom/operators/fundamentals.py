"""Point-in-time fundamentals: filing text, versions as of a date, value and quality factors."""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator, Sequence
from datetime import date

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from barloom.functions import text
from barloom.functions.asof import asof_join
from barloom.functions.windows import one_series, sure
from barloom.operators.calendar import minus_two_business_days, roll_forward

c = F.col
TTM_SPAN_DAYS = 456
ITEMS = (
    "revenue", "net_income", "ebit", "total_equity", "total_assets", "total_debt", "shares_outstanding", "cfo",
)
# Filing tags of each item, in priority order.
REVENUE = ("Revenue", "RevenueFromOperations", "RevenueFromContractsWithCustomers", "IncomeFromOperations", "GrossRevenue")
NET_INCOME = ("ProfitLossForPeriod", "ProfitLossForPeriodFromContinuingOperations", "ProfitLossForThePeriod",
              "ProfitLossFromOrdinaryActivitiesAfterTax")
PROFIT_BEFORE_TAX = ("ProfitBeforeExceptionalItemsAndTax", "ProfitLossBeforeExtraordinaryItemsAndTax", "ProfitLossBeforeTax")
FINANCE_COSTS = ("FinanceCosts", "FinanceCharges", "FinancialCosts", "InterestAndFinanceCharges")
EQUITY = ("Equity", "EquityAttributableToOwnersOfParent")
SHARE_CAPITAL = ("PaidUpValueOfEquityShareCapital",)
RESERVES = ("ReserveExcludingRevaluationReserves",)
ASSETS = ("Assets", "TotalAssets")
DEBT = ("Borrowings", "TotalBorrowings")
LONG_DEBT = ("BorrowingsNoncurrent", "LongTermBorrowings", "NonCurrentBorrowings")
SHORT_DEBT = ("BorrowingsCurrent", "ShortTermBorrowings", "CurrentBorrowings")
SHARES = ("NumberOfSharesOutstanding", "NumberOfEquitySharesOutstanding", "NumberOfEquitySharesOutstandingAtEndOfReportingPeriod")
FACE_VALUE = ("FaceValueOfEquityShareCapital",)
CFO = ("NetCashFlowsFromUsedInOperatingActivities", "CashFlowsFromUsedInOperatingActivities",
       "NetCashFromOperatingActivities", "CashGeneratedFromOperations")
DEBT_RATIO = ("DebtEquityRatio",)


def filing_items(doc: Column) -> dict[str, Column]:
    """Item columns of a filing text; derived items fall back to their parts."""

    def n(tags: Sequence[str]) -> Column:
        return text.first_tag_number(doc, tags)

    long_debt, short_debt = n(LONG_DEBT), n(SHORT_DEBT)
    parts = F.when(
        long_debt.isNotNull() | short_debt.isNotNull(),
        F.coalesce(long_debt, F.lit(0.0)) + F.coalesce(short_debt, F.lit(0.0)),
    )
    shares = text.first_positive_tag_number(doc, SHARE_CAPITAL) / text.first_positive_tag_number(doc, FACE_VALUE)
    return {
        "revenue": n(REVENUE),
        "net_income": n(NET_INCOME),
        "ebit": n(PROFIT_BEFORE_TAX) + n(FINANCE_COSTS),
        "total_equity": F.coalesce(n(EQUITY), n(SHARE_CAPITAL) + n(RESERVES)),
        "total_assets": n(ASSETS),
        "total_debt": F.coalesce(n(DEBT), parts),
        "shares_outstanding": F.coalesce(n(SHARES), shares),
        "cfo": n(CFO),
        "debt_equity_ratio": n(DEBT_RATIO),
    }


# The prefix of the standard items, what its address holds, and where it must be declared.
STANDARD_PREFIX, STANDARD_ADDRESS, DECLARED_WITHIN = "in-bse-fin", "in-bse-fin", 8000


def declares_standard(doc: Column) -> Column:
    """Whether the first declaration of the standard prefix names the standard's address."""
    address = F.regexp_extract(F.substring(doc, 1, DECLARED_WITHIN), f'xmlns:{STANDARD_PREFIX}="([^"]+)"', 1)
    return sure(address.contains(STANDARD_ADDRESS))


def parse_filings(docs: DataFrame, column: str = "text") -> DataFrame:
    """Items of each text and the list of those it does not give; whole texts are searched.

    A text that does not declare the standard's namespace gives no item.
    """
    known = declares_standard(c(column))
    out = docs.withColumns({name: F.when(known, item) for name, item in filing_items(c(column)).items()})
    gaps = F.array_compact(F.array(*[F.when(c(i).isNull(), F.lit(i)) for i in ITEMS]))
    return out.withColumn("unmapped_items", gaps)


def as_of(versions: DataFrame, days: DataFrame, keys: Sequence[str] = ("isin",)) -> DataFrame:
    """Versions visible on each day: newest available two business days earlier, per period.

    Each version is visible from its own date to the next version's; the days falling
    in that span are picked from one small calendar array, so nothing is paired that
    is not part of the result.  ``days`` holds weekdays, one row each.
    """
    pairs = days.select(F.struct(minus_two_business_days(c("date")).alias("cutoff"), c("date").alias("date")).alias("p"))
    calendar = pairs.agg(F.array_sort(F.collect_list("p"))).scalar()
    until = F.lead("available_date").over(Window.partitionBy(*keys, "period_end").orderBy("available_date"))
    spans = one_version(versions, keys).withColumn("_until", until)
    hit = F.filter(
        c("_days"),
        lambda p: (p["cutoff"] >= c("available_date")) & (c("_until").isNull() | (p["cutoff"] < c("_until"))),
    )
    seen = spans.withColumn("_days", calendar).withColumn("_p", F.explode(hit))
    return seen.withColumn("as_of", c("_p.date")).drop("_days", "_p", "_until")


def one_version(versions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per (key, period, available date); annual wins over quarterly on a tie."""
    rest = [x for x in versions.columns if x not in (*keys, "period_end", "available_date")]
    row = F.struct(*[F.col(x) for x in rest])
    return (
        versions.groupBy(*keys, "period_end", "available_date")
        .agg(F.min_by(row, "statement_type").alias("_r"))
        .select(*keys, "period_end", "available_date", "_r.*")
    )


STATE_ITEMS = ("net_income", "cfo", "total_equity", "total_assets", "total_debt", "shares_outstanding", "debt_equity_ratio")


def item_state(seen: DataFrame, keys: Sequence[str] = ("isin",)) -> DataFrame:
    """Per (as_of, isin): trailing-year flows, latest stocks and mean annual equity."""
    by = ["as_of", *keys]
    kind = Window.partitionBy(*by, "statement_type").orderBy(c("period_end").desc())
    eq_rank = Window.partitionBy(*by, "statement_type", c("total_equity").isNotNull()).orderBy(c("period_end").desc())
    df = seen.withColumns({"_n": F.row_number().over(kind), "_e": F.row_number().over(eq_rank)})
    quarter, annual = c("statement_type") == "Quarterly", c("statement_type") == "Annual"
    top4 = quarter & (c("_n") <= 4)
    last = annual & (c("_n") == 1)
    span = F.datediff(F.max(F.when(top4, c("period_end"))), F.min(F.when(top4, c("period_end"))))

    def ttm(item: str) -> Column:
        four = F.count(F.when(top4, c(item))) == 4
        return F.when(four & (span <= TTM_SPAN_DAYS), F.sum(F.when(top4, c(item)))).otherwise(
            F.max(F.when(last, c(item)))
        )

    def stock(item: str) -> Column:
        return F.max_by(item, F.when(c(item).isNotNull(), c("period_end")))

    two = annual & c("total_equity").isNotNull() & (c("_e") <= 2)
    return df.groupBy(*by).agg(
        ttm("net_income").alias("ttm_net_income"),
        ttm("cfo").alias("ttm_cfo"),
        *[stock(i).alias(i) for i in ("total_equity", "total_assets", "total_debt", "shares_outstanding", "debt_equity_ratio")],
        F.coalesce(F.avg(F.when(two, c("total_equity"))), stock("total_equity")).alias("avg_equity"),
    )


STOCKS = ("total_equity", "total_assets", "total_debt", "shares_outstanding", "debt_equity_ratio")
STATE = ("ttm_net_income", "ttm_cfo", *STOCKS, "avg_equity")


class PeriodTable:
    """The visible version of each period of one name, newest period first when read."""

    def __init__(self) -> None:
        self.ends: list[date] = []
        self.rows: dict[date, dict] = {}

    def put(self, row: dict) -> None:
        end = row["period_end"]
        if end not in self.rows:
            insort(self.ends, end)
        self.rows[end] = row

    def state(self) -> dict:
        """Trailing-year flows, latest stocks and mean annual equity; stops at the last period they need."""
        quarters: list[dict] = []
        annual: dict | None = None
        equities: list[float] = []
        stocks: dict[str, float] = {}
        for end in reversed(self.ends):
            row = self.rows[end]
            for item in STOCKS:
                if item not in stocks and row[item] is not None:
                    stocks[item] = row[item]
            if row["statement_type"] == "Quarterly" and len(quarters) < 4:
                quarters.append(row)
            elif row["statement_type"] == "Annual":
                annual = annual or row
                if len(equities) < 2 and row["total_equity"] is not None:
                    equities.append(row["total_equity"])
            if len(quarters) == 4 and annual and len(equities) == 2 and len(stocks) == len(STOCKS):
                break
        out: dict = {item: stocks.get(item) for item in STOCKS}
        near = len(quarters) == 4 and (quarters[0]["period_end"] - quarters[3]["period_end"]).days <= TTM_SPAN_DAYS
        for item in ("net_income", "cfo"):
            flows = [q[item] for q in quarters]
            out[f"ttm_{item}"] = sum(flows) if near and None not in flows else annual[item] if annual else None
        out["avg_equity"] = sum(equities) / len(equities) if equities else out["total_equity"]
        return out


def filing_states(versions: DataFrame) -> DataFrame:
    """State of each name after each day with filings (isin, since, items), by one pass over its versions.

    Versions meet by name in the order they became available; a task holds the periods of the name it
    is at, and nothing of the days between filings.  Annual wins over quarterly on the same day.
    """
    columns = ["isin", "available_date", "period_end", "statement_type", "net_income", "cfo", *STOCKS]
    ordered = one_version(versions, ["isin"]).select(*columns).repartition("isin").sortWithinPartitions("isin", "available_date")
    kind = ordered.schema["isin"].dataType.simpleString()
    names = ("isin", "since", *STATE)
    schema = f"isin {kind}, since date, " + ", ".join(f"{n} double" for n in STATE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: tuple | None = None  # name and day of the rows last read
        table = PeriodTable()
        out: list[tuple] = []
        for batch in batches:
            for row in batch.to_pylist():
                at = (row["isin"], row["available_date"])
                if here is not None and at != here:
                    state = table.state()
                    out.append((*here, *[state[n] for n in STATE]))
                    if at[0] != here[0]:
                        table = PeriodTable()
                here = at
                table.put(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names)
                out = []
        if here is not None:
            state = table.state()
            out.append((*here, *[state[n] for n in STATE]))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names)

    types = [to_arrow_type(ordered.schema["isin"].dataType), pa.date32(), *[pa.float64()] * len(STATE)]
    items = [c(x).cast("double").alias(x) for x in columns[4:]]
    return ordered.select(*columns[:4], *items).filter(c("isin").isNotNull()).mapInArrow(run, schema)


def states_on_days(states: DataFrame, days: DataFrame) -> DataFrame:
    """State of each name on each day from its first visible filing on: (as_of, isin, items).

    A state holds until the next one; its days are a slice of one small calendar array, so every row
    made is a row of the result.
    """
    pairs = days.select(F.struct(minus_two_business_days(c("date")).alias("cutoff"), c("date").alias("date")).alias("p"))
    calendar = pairs.agg(F.array_sort(F.collect_list("p"))).scalar()
    until = F.lead("since").over(Window.partitionBy("isin").orderBy("since"))
    hit = F.filter("_days", lambda p: (p["cutoff"] >= c("since")) & (c("_until").isNull() | (p["cutoff"] < c("_until"))))
    spans = states.withColumns({"_until": until, "_days": calendar})
    return spans.withColumn("_p", F.explode(hit)).select(c("_p.date").alias("as_of"), "isin", *STATE)


def market_cap(close_raw: Column, shares: Column) -> Column:
    return close_raw * shares


def book_to_price(equity: Column, close_raw: Column, shares: Column) -> Column:
    cap = market_cap(close_raw, shares)
    return F.when(cap > 0, equity / cap)


def earnings_yield_factor() -> Column:
    cap = market_cap(c("close_raw"), c("shares_outstanding"))
    return F.when((c("shares_outstanding") > 0) & (cap > 0), c("ttm_net_income") / cap)


def book_to_price_factor() -> Column:
    return F.when(
        (c("total_equity") > 0) & (c("shares_outstanding") > 0),
        book_to_price(c("total_equity"), c("close_raw"), c("shares_outstanding")),
    )


def roe_factor() -> Column:
    return F.when(c("avg_equity") > 0, c("ttm_net_income") / c("avg_equity"))


def accruals_factor() -> Column:
    return F.when(
        ~c("is_financial") & (c("total_assets") > 0), -(c("ttm_net_income") - c("ttm_cfo")) / c("total_assets")
    )


def leverage_factor() -> Column:
    return F.when(
        ~c("is_financial") & (c("total_equity") > 0),
        F.coalesce(
            -(c("total_debt") / c("total_equity")), F.when(c("debt_equity_ratio") >= 0, -c("debt_equity_ratio"))
        ),
    )


FUNDAMENTAL_FACTORS = {
    "earnings_yield": earnings_yield_factor,
    "book_to_price": book_to_price_factor,
    "roe": roe_factor,
    "accruals": accruals_factor,
    "leverage": leverage_factor,
}


def factor_frame(versions: DataFrame, prices: DataFrame, days: DataFrame, financial: DataFrame | None = None) -> DataFrame:
    """Factors of every name with a price on each rebalance day; missing items stay missing.

    ``prices`` has (isin, date, close_raw); ``days`` the rebalance weekdays.
    """
    on_day = prices.join(F.broadcast(days.select("date")), "date", "left_semi").select(
        "isin", c("date").alias("as_of"), "close_raw", minus_two_business_days(c("date")).alias("_cutoff")
    )
    df = asof_join(on_day, filing_states(versions), ["isin"], "_cutoff", "since", STATE, unique_left=True).drop("_cutoff")
    if financial is None:
        df = df.withColumn("is_financial", F.lit(False))
    else:
        flag = financial.select("isin").distinct().withColumn("is_financial", F.lit(True))
        df = df.join(flag, "isin", "left").withColumn("is_financial", sure(c("is_financial")))
    return df.select("isin", c("as_of").alias("date"), *[f().alias(n) for n, f in FUNDAMENTAL_FACTORS.items()])


def rebalance_days(calendar: DataFrame) -> DataFrame:
    """Month-end trading days moved to weekdays."""
    last = calendar.groupBy(F.trunc("date", "month")).agg(F.max("date").alias("date"))
    return last.select(roll_forward(c("date")).alias("date")).distinct()


def first_filed(versions: DataFrame) -> DataFrame:
    return versions.groupBy("isin").agg(F.min("available_date").alias("first_filed"))


def coverage(eligible: DataFrame, versions: DataFrame, good: DataFrame, name_floor: float = 0.75,
             weight_floor: float = 0.90) -> DataFrame:
    """Per date, share of eligible filers that are covered, by count and by weight.

    ``eligible`` is (date, isin, weight); ``good`` (date, isin) of covered names.
    """
    filers = eligible.join(first_filed(versions), "isin").filter(c("first_filed") <= minus_two_business_days(c("date")))
    df = filers.join(good.select("date", "isin", F.lit(1).alias("_ok")), ["date", "isin"], "left")
    hit = F.coalesce("_ok", F.lit(0))
    out = df.groupBy("date").agg(F.avg(hit).alias("name_pct"), F.try_divide(F.sum(hit * c("weight")), F.sum("weight")).alias("weight_pct"))
    return out.withColumn("failed", (c("name_pct") < name_floor) | (c("weight_pct") < weight_floor))


def durable_start(pct: DataFrame, floor: float = 0.75) -> DataFrame:
    """First date from which the share never falls below the floor again."""
    w = one_series("date").rowsBetween(0, Window.unboundedFollowing)
    return pct.withColumn("_low", F.min("pct").over(w)).filter(c("_low") >= floor).agg(F.min("date").alias("start"))


def factor_steps(prices: DataFrame, min_step: float = 0.05) -> DataFrame:
    """Days on which the adjustment factor jumps."""
    prev = F.lag("adj_factor").over(Window.partitionBy("isin").orderBy("date"))
    return prices.select("isin", "date", (c("adj_factor") / prev).alias("step")).filter(F.abs(c("step") - 1) > min_step)


def share_reconciliation(steps: DataFrame, versions: DataFrame, tol: float = 0.02) -> DataFrame:
    """Shares before and after each factor step against the ratio the step implies.

    Before: newest period visible at the ex-date.  After: newest later period visible
    400 days on.
    """
    one = one_version(versions, ["isin"])

    def newest(points: DataFrame, day: Column, tag: str) -> DataFrame:
        # The newest visible period is the running maximum of period_end by availability.
        w = Window.partitionBy("isin").orderBy("available_date").rangeBetween(Window.unboundedPreceding, 0)
        state = one.withColumn("_s", F.max(F.struct("period_end", "available_date", "shares_outstanding")).over(w))
        state = state.groupBy("isin", c("available_date").alias("_a")).agg(F.max("_s").alias("_s"))
        state = state.select("isin", "_a", c("_s.period_end").alias(f"p_{tag}"), c("_s.shares_outstanding").alias(f"s_{tag}"))
        left = points.withColumn("_cut", minus_two_business_days(roll_forward(day)))
        return asof_join(left, state, ["isin"], "_cut", "_a", [f"p_{tag}", f"s_{tag}"]).drop("_cut")

    df = newest(newest(steps, c("date"), "before"), F.date_add("date", 400), "after")
    df = df.filter((c("p_after") > c("p_before")) & (c("s_before") != 0))
    observed = c("s_after") / c("s_before")
    return df.select(
        "isin", "date", "step", observed.alias("observed"), (F.try_divide(F.abs(observed - c("step")), c("step")) > tol).alias("failed")
    )


def pit_violations(versions: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows filed no later than their period, or shown before they were available."""
    early = versions.filter(c("available_date") <= c("period_end")).select(
        "isin", "period_end", "available_date", F.lit("filed before period end").alias("problem")
    )
    late = seen.filter(c("available_date") > minus_two_business_days(c("as_of"))).select(
        "isin", "period_end", "available_date", F.lit("visible before available").alias("problem")
    )
    return early.unionByName(late)


def replay_cases(versions: DataFrame) -> DataFrame:
    """Per version two probe days: one on which it must not show, one on which it must (or a newer one)."""
    base = roll_forward(F.date_add("available_date", 1))
    return versions.select(
        "isin",
        "period_end",
        "available_date",
        F.explode(F.array(roll_forward(c("available_date")), roll_forward(F.date_add(base, 6)))).alias("as_of"),
    ).withColumn("visible", c("available_date") <= minus_two_business_days(c("as_of")))


def reconciliation(versions: DataFrame, reference: DataFrame, items: Sequence[str], tol: float = 0.02) -> DataFrame:
    """Latest version of each period against a reference, item by item."""
    rest = F.struct(*items)
    newest = versions.groupBy("isin", "period_end").agg(F.max_by(rest, "available_date").alias("_r")).select("isin", "period_end", "_r.*")
    ours = newest.unpivot(["isin", "period_end"], list(items), "item", "ours")
    theirs = reference.unpivot(["isin", "period_end"], list(items), "item", "theirs")
    err = F.when(c("theirs") != 0, F.abs(c("ours") - c("theirs")) / F.abs(c("theirs")))
    return ours.join(theirs, ["isin", "period_end", "item"]).select(
        "isin", "period_end", "item", err.alias("rel_error"), sure(err > tol).alias("failed")
    )


def missing_delistings(known: DataFrame, master: DataFrame) -> DataFrame:
    return known.join(master.select("isin").distinct(), "isin", "left_anti").distinct()
