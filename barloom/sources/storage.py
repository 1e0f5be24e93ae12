"""Parquet tables: scans with derived partition predicates, contracts, idempotent sinks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    DateType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
)

c = F.col


def _schema(**fields) -> StructType:
    kinds = {"s": StringType(), "d": DoubleType(), "l": LongType(), "t": DateType(), "b": BooleanType()}
    return StructType([StructField(k, kinds[v]) for k, v in fields.items()])


# Column contracts of the stored tables.
PRICES_ADJUSTED = _schema(
    isin="s", symbol="s", date="t", open="d", high="d", low="d", close="d", close_raw="d", close_tr="d",
    volume="l", traded_value="d", adv_20="d", adj_factor="d", tr_factor="d", series="s", instrument_id="s",
)
MEMBERSHIP = _schema(isin="s", date="t")
SYMBOL_MAP = _schema(isin="s", symbol="s", first_date="t", last_date="t", instrument_id="s")
CORPORATE_ACTIONS = _schema(isin="s", symbol="s", ex_date="t", type="s", ratio="d", dividend="d", subject="s")
VOLATILITY = _schema(date="t", india_vix="d")


class ContractError(ValueError):
    """A frame does not have exactly the columns its table requires."""


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach; a machine-local one only on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-barloom-", dir="/tmp")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of an iterative job's state."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def conform(df: DataFrame, schema: StructType, table: str) -> DataFrame:
    """Exact-column contract: missing or extra columns raise, the rest is reordered and cast."""
    want, have = [f.name for f in schema], df.columns
    missing, extra = sorted(set(want) - set(have)), sorted(set(have) - set(want))
    if missing or extra:
        raise ContractError(f"{table}: missing columns {missing}, extra columns {extra}")
    return df.select(*[c(f.name).cast(f.dataType).alias(f.name) for f in schema])


def write_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Overwrite only the partitions present in ``df``; running it twice changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_by_year(df: DataFrame, path: str, key: str | None = None) -> None:
    """Year partitions; files range-clustered on the key so its statistics prune scans."""
    out = df.withColumn("year", F.year("date"))
    if key is not None:
        out = out.repartitionByRange(F.col("year"), F.col(key), F.col("date"))
    write_partitions(out, path, ["year"])


def read_or_empty(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Small reference table; an absent folder is an empty table."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], schema)
    return spark.read.parquet(path)


def year_bounds(start=None, end=None) -> Column | None:
    """Partition predicate that the date range implies."""
    parts = []
    if start is not None:
        parts.append(c("year") >= F.year(F.lit(start).cast("date")))
    if end is not None:
        parts.append(c("year") <= F.year(F.lit(end).cast("date")))
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else parts[0] & parts[1]


def read_between(spark: SparkSession, path: str, start=None, end=None) -> DataFrame:
    df = spark.read.parquet(path)
    bounds = year_bounds(start, end)
    if bounds is not None:
        df = df.filter(bounds)
    if start is not None:
        df = df.filter(c("date") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.filter(c("date") <= F.lit(end).cast("date"))
    return df.drop("year")


def read_prices(spark, path, isins=None, instrument_ids=None, start=None, end=None) -> DataFrame:
    df = read_between(spark, path, start, end)
    if isins is not None:
        df = df.filter(c("isin").isin(*isins))
    if instrument_ids is not None:
        df = df.filter(c("instrument_id").isin(*instrument_ids))
    return df


def read_membership(spark, path, on=None, start=None, end=None) -> DataFrame:
    return read_between(spark, path, on or start, on or end)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Newest row per key; max_by combines before the shuffle, so hot keys stay small."""
    both = old.unionByName(new)
    rest = [x for x in both.columns if x not in keys]
    row = F.struct(*rest)
    return both.groupBy(*keys).agg(F.max_by(row, c(version)).alias("_r")).select(*keys, "_r.*").select(*both.columns)


def retain(df: DataFrame, today: Column, days: dict[str, int], default: int) -> tuple[DataFrame, DataFrame]:
    """Rows young enough per timeframe, and counts of those let go."""
    limit = F.lit(default)
    for tf, n in sorted(days.items()):
        limit = F.when(c("timeframe") == tf, n).otherwise(limit)
    fresh = F.datediff(today, c("date")) <= limit
    gone = df.filter(~fresh).groupBy("timeframe").agg(F.count("*").alias("deleted"))
    return df.filter(fresh), gone


def partition_values(spark: SparkSession, path: str) -> list[dict[str, str]]:
    """Values of the partition folders below a path, from the file system's listing alone."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def below(folder, values: dict[str, str]) -> list[dict[str, str]]:
        inner = [f.getPath() for f in fs.listStatus(folder) if f.isDirectory() and "=" in f.getPath().getName()]
        if not inner:
            return [values] if values else []
        return [x for p in inner for x in below(p, values | {p.getName().split("=")[0]: p.getName().split("=", 1)[1]})]

    return sorted(below(root, {}), key=str) if fs.exists(root) else []


def drop_partition(spark: SparkSession, path: str, values: dict[str, str]) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "".join(f"/{k}={v}" for k, v in values.items()))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@dataclass(frozen=True)
class Retention:
    """How long a table's rows stay: days by timeframe where it has one, else ``days``."""

    path: str
    days: int
    by_timeframe: dict[str, int] = field(default_factory=dict)
    date: str = "date"


def clean_up(spark: SparkSession, tables: dict[str, Retention], today: date) -> dict[str, int]:
    """Delete what is older than each table's limit; rows deleted by table (and timeframe).

    Tables are partitioned by year, or by timeframe and year.  Whole years before the cutoff go by
    their folders, the cutoff's own year is written again without its old days, and nothing else is
    read or written.  Running it twice deletes nothing more.
    """
    deleted: dict[str, int] = {}
    for name, table in tables.items():
        for values in partition_values(spark, table.path):
            tf = values.get("timeframe")
            label = name if tf is None else f"{name}_{tf}"
            deleted.setdefault(label, 0)
            cutoff = today - timedelta(days=table.by_timeframe.get(tf, table.days))
            if int(values["year"]) > cutoff.year:
                continue
            here = reduce(lambda a, b: a & b, [c(k) == v for k, v in values.items()])
            rows = spark.read.parquet(table.path).filter(here)
            if int(values["year"]) < cutoff.year:
                deleted[label] += rows.count()
                drop_partition(spark, table.path, values)
                continue
            old = rows.filter(c(table.date) < F.lit(cutoff)).count()
            if old:
                kept = cut_lineage(rows.filter(~F.coalesce(c(table.date) < F.lit(cutoff), F.lit(False))))
                if kept.isEmpty():
                    drop_partition(spark, table.path, values)
                else:
                    write_partitions(kept, table.path, list(values))
                deleted[label] += old
    return deleted


FILING_KEY = ("isin", "period_end", "available_date", "statement_type")


def populate_filing_index(incoming: DataFrame, path: str, errors: str, run_id: str) -> DataFrame:
    """Merge filings into the index on its 4-column key; what was not after its period goes to the error table.

    The index is partitioned by the year of the period.  Stored rows stay as they are, a key counts once,
    and only years that get new rows are written, in one partition overwrite; the errors of a run are one
    partition of their table.  So a run that is repeated, or was cut off half-way, ends in the same tables.
    Returns one row: rows_inserted, rows_known, pit_violations.
    """
    spark = incoming.sparkSession
    good, bad = split_filing_index(incoming)
    rest = [x for x in good.columns if x not in FILING_KEY]
    pick = F.min(F.struct(*rest)).alias("_r") if rest else F.lit(None).alias("_r")
    once = good.groupBy(*FILING_KEY).agg(pick).select(*FILING_KEY, *(["_r.*"] if rest else [])).withColumn("year", F.year("period_end"))
    stored = read_or_empty(spark, path, once.schema)
    keys = once.count()
    fresh = cut_lineage(once.join(stored.select(*FILING_KEY, "year"), [*FILING_KEY, "year"], "left_anti"))
    years = fresh.select("year").distinct()
    if not fresh.isEmpty():
        touched = stored.join(F.broadcast(years), "year", "left_semi").select(*fresh.columns)  # one row a year
        write_partitions(cut_lineage(touched.unionByName(fresh)), path, ["year"])
    write_partitions(bad.withColumn("run_id", F.lit(run_id)), errors, ["run_id"])
    inserted = fresh.count()
    return spark.createDataFrame([(inserted, keys - inserted, bad.count())], "rows_inserted long, rows_known long, pit_violations long")


def append_new(stored: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Restatement-preserving append: stored versions stay, unknown keys are added."""
    return stored.unionByName(incoming.join(stored.select(*keys), list(keys), "left_anti"))


def correct(stored: DataFrame, reparsed: DataFrame, keys: Sequence[str], items: Sequence[str]) -> DataFrame:
    """Reparsed item values replace the stored ones of the same version; new keys are inserted."""
    new = reparsed.select(*keys, F.lit(True).alias("_new"), *[c(i).alias(f"_n_{i}") for i in items])
    joined = stored.join(new, list(keys), "full_outer")
    cols = [
        F.when(c("_new"), c(f"_n_{x}")).otherwise(c(x)).alias(x) if x in items else c(x) for x in stored.columns
    ]
    return joined.select(*cols)


def missing_item_errors(filings: DataFrame, keys: Sequence[str], items: Sequence[str]) -> DataFrame:
    """One error row per item a filing does not have."""
    names = F.array_compact(F.array(*[F.when(c(i).isNull(), F.lit(i)) for i in items]))
    return filings.select(*keys, F.explode(names).alias("unmapped_item"))


def split_filing_index(filings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable filings, and those not after the period they report."""
    late = c("available_date") > c("period_end")
    bad = filings.filter(~F.coalesce(late, F.lit(False))).withColumn("error", F.lit("available_date <= period_end"))
    return filings.filter(late), bad


def listings(membership: DataFrame) -> DataFrame:
    """First and last day of each id; still listed when seen on the table's last day."""
    edge = membership.agg(F.max("date")).scalar()
    df = membership.groupBy("isin").agg(
        F.min("date").alias("list_date"), F.max("date").alias("_last"), F.max_by("symbol", "date").alias("symbol")
    )
    return df.select("isin", "symbol", "list_date", F.when(c("_last") != edge, c("_last")).alias("delist_date"))


def sync_positions(journal: DataFrame, positions: DataFrame) -> DataFrame:
    """Positions into the journal on (source, external_id); columns depend on their state."""
    closed = c("status") == "closed"
    incoming = positions.select(
        F.lit("paper").alias("source"),
        c("trade_id").alias("external_id"),
        "symbol",
        "entry_date",
        "entry_price",
        "status",
        F.when(closed, c("exit_date")).alias("exit_date"),
        F.when(closed, c("exit_price")).alias("exit_price"),
        F.when(closed, (c("exit_price") - c("entry_price")) * c("qty")).alias("pnl"),
        c("version"),
    )
    return upsert(journal, incoming, ["source", "external_id"], "version")


def wide_to_long(wide: DataFrame, symbols: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Columns named symbol_field to one row per symbol and date, all-null rows dropped."""
    rows = F.array(
        *[
            F.struct(F.lit(s).alias("symbol"), *[c(f"{s}_{f}").alias(f) for f in fields])
            for s in symbols
        ]
    )
    return wide.select("date", F.inline(rows)).dropna(how="all", subset=list(fields))


def daily_volatility(ticks: DataFrame) -> DataFrame:
    """Last non-null value of each day; gaps stay gaps."""
    return (
        ticks.filter(c("value").isNotNull() & ~F.isnan("value"))
        .groupBy(F.to_date("ts").alias("date"))
        .agg(F.max_by("value", F.struct("ts", "value")).alias("india_vix"))
    )


INDEX_ROW = StructType([StructField("Date", StringType()), StructField("TotalReturnsIndex", StringType())])


def index_levels(rows: DataFrame, column: str = "json") -> DataFrame:
    """JSON index rows to (date, level); thousands separators are dropped."""
    r = F.from_json(c(column), INDEX_ROW)
    return (
        rows.select(r.alias("r"))
        .select(
            F.try_to_timestamp(c("r.Date"), F.lit("dd MMM yyyy")).cast("date").alias("date"),
            F.regexp_replace(c("r.TotalReturnsIndex"), ",", "").try_cast("double").alias("level"),
        )
        .dropna()
    )


# Column names of the two published daily-bar layouts.
LEGACY = StructType([StructField(n, StringType()) for n in (
    "SYMBOL", "SERIES", "OPEN", "HIGH", "LOW", "CLOSE", "LAST", "PREVCLOSE", "TOTTRDQTY", "TOTTRDVAL",
    "TIMESTAMP", "TOTALTRADES", "ISIN", "_TAIL")])
LEGACY_FIELDS = dict(isin="ISIN", symbol="SYMBOL", date="TIMESTAMP", open="OPEN", high="HIGH", low="LOW",
                     close="CLOSE", volume="TOTTRDQTY", traded_value="TOTTRDVAL", series="SERIES")
UDIFF_FIELDS = dict(isin="ISIN", symbol="TckrSymb", date="TradDt", open="OpnPric", high="HghPric", low="LwPric",
                    close="ClsPric", volume="TtlTradgVol", traded_value="TtlTrfVal", series="SctySrs")
UDIFF = StructType([StructField(n, StringType()) for n in (*UDIFF_FIELDS.values(), "FinInstrmTp", "XpryDt")])
SERIES = ("EQ",)
NO_EXPIRY = ("", "nan", "-")


def _unified(raw: DataFrame, fields: dict[str, str], formats: Sequence[str]) -> DataFrame:
    text = lambda k: F.trim(c(fields[k]))
    num = lambda k: text(k).try_cast("double")
    day = F.coalesce(*[F.try_to_timestamp(text("date"), F.lit(f)) for f in formats]).cast("date")
    df = raw.filter(text("series").isin(*SERIES) & c(fields["isin"]).isNotNull()).select(
        text("isin").alias("isin"),
        text("symbol").alias("symbol"),
        day.alias("date"),
        *[num(k).alias(k) for k in ("open", "high", "low", "close")],
        F.round(num("volume")).cast("long").alias("volume"),
        num("traded_value").alias("traded_value"),
        text("series").alias("series"),
    )
    return df.dropna(subset=["open", "high", "low", "close"]).filter((c("open") > 0) & (c("close") > 0))


def legacy_bars(raw: DataFrame) -> DataFrame:
    return _unified(raw, LEGACY_FIELDS, ("dd-MMM-yyyy", "dd-MMM-yy"))


def udiff_bars(raw: DataFrame) -> DataFrame:
    expiry = F.coalesce(F.trim("XpryDt"), F.lit(""))
    return _unified(raw.filter((c("FinInstrmTp") == "STK") & expiry.isin(*NO_EXPIRY)), UDIFF_FIELDS, ("yyyy-MM-dd",))


def read_bar_files(spark: SparkSession, path, layout: str) -> DataFrame:
    """CSV files of one layout to unified rows; the schema is given, never inferred.

    The newer files are read by header name, since they carry more columns than used.
    """
    reader = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True)
    if layout == "legacy":
        return legacy_bars(reader.schema(LEGACY).csv(path))
    if layout == "udiff":
        return udiff_bars(reader.option("enforceSchema", False).csv(path))
    raise ValueError(f"unknown layout {layout!r}")


def newest_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(c("_n") == 1).drop("_n")
