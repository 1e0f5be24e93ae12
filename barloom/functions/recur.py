"""First-order linear recurrences as native window sums.

Every recursive average used on bars (EMA, Wilder average) has the shape
``y[t] = d * y[t-1] + term[t]``.  Unrolled, ``y[t] = d**t * sum(term[i] * d**-i)``,
which is one running ``sum`` window and needs no Python worker.  ``d**-i`` would
overflow on long histories, so fast-decaying recurrences restart the exponent
every ``block`` bars and add the last value of the preceding block; what lies two
blocks back weighs ``d**block`` (below 1e-15) and cannot change a double.

The window is per instrument and timeframe, hence bounded by the number of bars
one instrument can have (one per day), whatever the volume of the raw feed.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BAR = "_bar"


@dataclass(frozen=True)
class Recurrence:
    """``out[t] = decay * out[t-1] + alpha * x[t]``, seeded at bar ``start``."""

    out: str
    x: Column
    decay: float
    start: int
    seed: Column

    @property
    def block(self) -> int:
        """Bars after which the exponent restarts: the smallest multiple of 500 or 2,000 whose decay is below 1e-15."""
        needed = math.log(1e-15) / math.log(self.decay)
        return 500 if needed <= 500 else 2_000 * math.ceil(needed / 2_000)


def number_bars(df: DataFrame, keys: Sequence[str], order: str = "date") -> DataFrame:
    """Add the 0-based position of each bar within its key."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn(BAR, F.row_number().over(w) - 1)


def ema_of(out: str, x: Column, span: int, first: int = 0, sma_seed: Column | None = None) -> Recurrence:
    """EMA of ``x``: seeded by its first value, or by ``sma_seed`` at bar first+span-1."""
    decay = 1.0 - 2.0 / (span + 1.0)
    start = first if sma_seed is None else first + span - 1
    return Recurrence(out, x, decay, start, x if sma_seed is None else sma_seed)


def wilder_of(out: str, x: Column, n: int, seed: Column, first: int = 0) -> Recurrence:
    """Wilder average: plain mean of the first ``n`` values, then weight 1/n."""
    return Recurrence(out, x, 1.0 - 1.0 / n, first + n - 1, seed)


TABLED = 500  # powers of blocks up to this size are looked up


def power(decay: float, sign: int, offset: Column, block: int) -> Column:
    """``decay ** (sign * offset)`` for offsets of at most ``block``.

    In short blocks it is looked up: computing it takes longer, and the last bits are the C library's, not the JVM's.
    """
    if block > TABLED:
        return F.pow(F.lit(decay), sign * offset)
    values = ",".join(repr(math.pow(decay, sign * k)) for k in range(block + 1))
    return F.get(F.split(F.lit(values), ",").cast("array<double>"), offset.cast("int"))


def nested_blocks(items: Sequence[Recurrence]) -> dict[int, int]:
    """Each recurrence's block, raised where needed so that every block is a multiple of the next smaller one."""
    out: dict[int, int] = {}
    last = 1
    for block in sorted({r.block for r in items}):
        last = last * math.ceil(block / last)
        out[block] = last
    return out


def number_blocks(df: DataFrame, items: Sequence[Recurrence]) -> DataFrame:
    """Add the block numbers that ``items`` need, for :func:`solve` and the windows around it."""
    sizes = sorted(set(nested_blocks(items).values()), reverse=True)
    return df.withColumns({f"_block{n}": F.floor(F.col(BAR) / n) for n in sizes})


def block_names(df: DataFrame) -> list[str]:
    """Block columns of a table, largest block first."""
    sizes = (c.removeprefix("_block") for c in df.columns if c.startswith("_block"))
    return [f"_block{n}" for n in sorted((int(n) for n in sizes if n.isdigit()), reverse=True)]


def time_order(df: DataFrame, order: str = "date") -> list[str]:
    """Order of a key's bars by time that starts with the blocks, so that one sort serves all windows."""
    return [*block_names(df), order]


def solve(df: DataFrame, items: Sequence[Recurrence], keys: Sequence[str], order: str = "date") -> DataFrame:
    """Add one column per recurrence; needs the ``_bar`` column of :func:`number_bars`.

    Blocks nest, and all windows are ordered by (largest block, ..., smallest block, date), which is the
    order of the dates.  So one sort serves the windows of every block size and those over whole keys.
    Blocks numbered before by :func:`number_blocks` are used and stay.
    """
    bar = F.col(BAR)
    nested = nested_blocks(items)
    stay = block_names(df)
    if not {f"_block{n}" for n in nested.values()} <= set(stay):
        df, stay = number_blocks(df.drop(*stay), items), []
    names = block_names(df)

    def offset(r: Recurrence) -> Column:
        return bar % nested[r.block]

    local: dict[str, Column] = {}
    for r in items:
        term = (
            F.when(bar < r.start, 0.0)
            .when(bar == r.start, r.seed)
            .otherwise((1.0 - r.decay) * r.x)
        )
        inner = names.index(f"_block{nested[r.block]}") + 1
        w = Window.partitionBy(*keys, *names[:inner]).orderBy(*names[inner:], order).rowsBetween(Window.unboundedPreceding, 0)
        scaled = F.sum(term * power(r.decay, -1, offset(r), nested[r.block])).over(w)
        local[f"_{r.out}"] = scaled * power(r.decay, 1, offset(r), nested[r.block])
    out = df.withColumns(local)

    before = Window.partitionBy(*keys).orderBy(*names, order).rowsBetween(Window.unboundedPreceding, -1)
    final: dict[str, Column] = {}
    for r in items:
        value = F.col(f"_{r.out}")
        block_end = F.when(offset(r) == nested[r.block] - 1, value)
        carried = F.last(block_end, ignorenulls=True).over(before)
        left = F.when(carried.isNull(), 0.0).otherwise(carried * power(r.decay, 1, offset(r) + 1, nested[r.block]))
        final[r.out] = F.when(bar >= r.start, value + left)
    return out.withColumns(final).drop(*local, *([] if stay else names))
