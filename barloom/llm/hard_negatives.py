"""Hard negatives by an inverted multi-index with certified stops.

Vectors become integers, floor(scale * x). Each is cut in two halves; a codebook of each half is trained
by k-means on about ``SAMPLE`` rows, picked by hash (at most twice as many), and a row's cell is its pair of nearest
codewords. A codeword keeps its radius, the greatest distance of any row's half from it, over all rows.
A half's score with an anchor a is then at most ``a.c + |a| radius`` and at least ``a.c - |a| radius``,
and a row's score lies between the sums of its cell's two bounds.

Every task holds some cells and visits them, anchor by anchor, from a heap in order of the summed upper
bounds (multi-sequence: both halves' bounds sorted, a visited pair pushes its two successors). The walk
stops at the first cell whose upper bound cannot reach what the anchor still needs; cells whose lower
bound lies above all of an anchor's windows are passed over. Four walks, over all rows each:

1. the best cells, about an eighth of the rows: the 5th best positive found is a floor for
2. the positives: every cell that may hold a score at or above the floor;
3. the best cells again: the 10th best score inside each positive's window is a floor for
4. the negatives: every cell that may hold a score between floor and ceiling of a window.

Bounds hold for all rows, so results are exact, whatever the codebooks are. The anchors go in blocks of
``ANCHOR_BLOCK``, and what is broadcast is a block with its floors and the two codebooks of at most 256
codewords. Rows are dealt by ranges of (cell, id), so a cell of many copies lies on several tasks.

Rows with a null id, label, vector, or a null or non-finite component take no part; nor do rows whose
length differs from most rows' (the shortest of the commonest lengths counts), nor rows with a component
so great that a score could leave 64 bits (length * component**2 >= 2**62). Rows that share an id are not
each other's partners, and each of them is an anchor or a partner by itself. Ties go to the smaller id. An anchor without positives has no rows, a positive
without negatives neither; an empty table gives none. Negative positives have empty windows. Other
columns, of whatever name, are left out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import written

SAMPLE = 20_000  # rows that train the codebooks
ROWS_A_CELL = 32  # sought on average; at most 256 codewords a half
ANCHOR_BLOCK = 4096
TASK_ROWS = 8192
PROBED = 8  # an eighth of the rows is walked first
ROUNDS = 8
ROW = "vec_id long, label long, x array<long>"
CELL = ROW + ", i int, j int, r1 double, r2 double"
FOUND = "anchor int, win int, vec_id long, score long"


def usable(vectors: DataFrame, scale: int) -> DataFrame:
    x = F.col("embedding").cast("array<double>")
    size = F.size(x)
    great = F.sqrt(F.lit(2.0**62) / F.greatest(size, F.lit(1)))
    whole = F.transform(x, lambda v: F.floor(v * F.lit(float(scale))))
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * F.lit(float(scale))) < great - 1))
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & (size > 0) & sound
    return vectors.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform(whole, lambda v: v.cast("long")).alias("x"))


def stacked(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest codeword of each row and the distance to it."""
    near = np.empty(len(x), np.int64)
    for a in range(0, len(x), 4096):
        part = x[a : a + 4096]
        near[a : a + 4096] = np.argmin((book**2).sum(1)[None, :] - 2 * part @ book.T, axis=1)
    return near, np.sqrt(((x - book[near]) ** 2).sum(1))


def codebook(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    points = np.unique(x, axis=0)
    book = points[rng.permutation(len(points))[:k]].astype(np.float64)
    for _ in range(ROUNDS):
        near, _ = nearest(x, book)
        n = np.bincount(near, minlength=len(book))
        sums = np.zeros_like(book)
        np.add.at(sums, near, x)
        book[n > 0] = sums[n > 0] / n[n > 0][:, None]
    return book


def inner(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of ``x`` with ``q``."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * len(q)
    return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64) if top < 2**53 else x @ q


class Index:
    """Codebooks, radii and cell sizes: all that the bounds need."""

    def __init__(self, books: tuple[np.ndarray, np.ndarray]) -> None:
        self.books, self.cut = books, books[0].shape[1]
        self.radii = tuple(np.zeros(len(b)) for b in books)
        self.rows = np.zeros(tuple(map(len, books)), np.int64)

    def cells(self, x: np.ndarray):
        halves = x[:, : self.cut].astype(np.float64), x[:, self.cut :].astype(np.float64)
        return [nearest(h, b) for h, b in zip(halves, self.books)]

    def bounds(self, q: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """(upper, lower) bound of each codeword's half scores with an anchor, for both halves."""
        out = []
        for h, book, radius in zip((q[: self.cut], q[self.cut :]), self.books, self.radii):
            h = h.astype(np.float64)
            mid, reach = book @ h, np.sqrt(h @ h) * radius
            slack = 1e-9 * (np.abs(mid) + reach + np.abs(book) @ np.abs(h)) + 1e-6  # of rounding
            out.append((mid + reach + slack, mid - reach - slack))
        return tuple(out)


def walk(upper: tuple[np.ndarray, np.ndarray], here: tuple[np.ndarray, np.ndarray], floor: float) -> Iterator[tuple[int, int, float]]:
    """Pairs of codewords present here, by falling summed bound, down to ``floor``."""
    rows, cols = here
    u, v = upper[0][rows], upper[1][cols]
    a, b = np.argsort(-u, kind="stable"), np.argsort(-v, kind="stable")
    u, v, rows, cols = u[a].tolist(), v[b].tolist(), rows[a].tolist(), cols[b].tolist()
    heap = [(-(u[0] + v[0]), 0, 0)]
    while heap:
        bound, s, t = heapq.heappop(heap)
        if -bound < floor:
            return
        yield rows[s], cols[t], -bound
        if t + 1 < len(v):
            heapq.heappush(heap, (-(u[s] + v[t + 1]), s, t + 1))
        if t == 0 and s + 1 < len(u):
            heapq.heappush(heap, (-(u[s + 1] + v[0]), s + 1, 0))


class Wanted:
    """Anchors of a block with, for each, its windows: [low, high] of scores, how many, same label or not."""

    def __init__(self, ids, labels, x, same: bool, k: int) -> None:
        self.ids, self.labels, self.x, self.same, self.k = ids, labels, x, same, k
        n = len(ids)
        lowest = np.iinfo(np.int64).min
        self.low = [[lowest] for _ in range(n)]
        self.high = [[-lowest - 1] for _ in range(n)]
        self.stop = np.full(n, -np.inf)  # cells below this upper bound are not walked

    def probe(self, index: Index) -> None:
        """Stop where the best cells, without those above all windows, hold an eighth of the rows."""
        share = -(-int(index.rows.sum()) // PROBED)
        for n, q in enumerate(self.x):
            (u, lu), (v, lv) = index.bounds(q)
            top = (u[:, None] + v[None, :]).ravel()
            counted = np.where((lu[:, None] + lv[None, :]).ravel() > max(self.high[n], default=-np.inf), 0, index.rows.ravel())
            order = np.argsort(-top)
            at = np.searchsorted(np.cumsum(counted[order]), share)
            self.stop[n] = top[order[min(at, len(order) - 1)]]

    def certify(self) -> None:
        """Stop below the lowest score that any window still admits."""
        for n, low in enumerate(self.low):
            self.stop[n] = float(min(low)) if low else np.inf


def best_rows(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties by smaller id."""
    if len(score) > 4 * k:
        edge = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= edge)
        return at[np.lexsort((ids[at], -score[at]))[:k]]
    return np.lexsort((ids, -score))[:k]


def search(batches: Iterator[pa.RecordBatch], index: Index, wanted: Wanted) -> Iterator[pa.RecordBatch]:
    """The best rows of each window among this task's rows."""
    for part in chunks(batches):
        key = part["i"] * len(index.books[1]) + part["j"]
        order = np.argsort(key, kind="stable")
        ids, labels, x = part["vec_id"][order], part["label"][order], part["x"][order]
        cells, begin = np.unique(key[order], return_index=True)
        span = dict(zip(cells.tolist(), zip(begin.tolist(), [*begin[1:].tolist(), len(key)])))
        here = np.unique(part["i"]), np.unique(part["j"])
        width = len(index.books[1])
        out = []
        for n in range(len(wanted.ids)):
            if not wanted.low[n]:
                continue
            (u, lu), (v, lv) = index.bounds(wanted.x[n])
            least, most = min(wanted.low[n]), max(wanted.high[n])
            spans = []
            for i, j, _ in walk((u, v), here, wanted.stop[n]):
                at = span.get(i * width + j)
                if at is not None and lu[i] + lv[j] <= most:
                    spans.append(at)
            if not spans:
                continue
            rows = np.concatenate([np.arange(a, b) for a, b in spans])
            rows = rows[((labels[rows] == wanted.labels[n]) == wanted.same) & (ids[rows] != wanted.ids[n])]
            score = inner(wanted.x[n], x[rows])
            fit = (score >= least) & (score <= most)
            rows, score = rows[fit], score[fit]
            for w, (low, high) in enumerate(zip(wanted.low[n], wanted.high[n])):
                inside = np.flatnonzero((score >= low) & (score <= high))
                best = inside[best_rows(score[inside], ids[rows[inside]], wanted.k)]
                if len(best):
                    out.append((np.full(len(best), n), np.full(len(best), w), ids[rows[best]], score[best]))
        if out:
            anchor, win, got, score = (np.concatenate(c) for c in zip(*out))
            yield pa.RecordBatch.from_pydict({"anchor": anchor.astype(np.int32), "win": win.astype(np.int32), "vec_id": got, "score": score})


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """A task's rows in bounded parts."""
    held, n = [], 0

    def whole():
        table = pa.Table.from_batches(held).combine_chunks()
        out = {c: table.column(c).to_numpy() for c in ("vec_id", "label", "i", "j")}
        return out | {"x": np.concatenate([stacked(b) for b in held])}

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= 2 * TASK_ROWS:
            yield whole()
            held, n = [], 0
    if held:
        yield whole()


def indexed(rows: DataFrame, n: int) -> tuple[DataFrame, Index]:
    """All rows with their cells, dealt by ranges of cells, and the index of their bounds."""
    below = F.lit(SAMPLE / n * 2.0**63)
    picked = rows.where(F.abs(F.xxhash64("vec_id", "x").cast("double")) <= below) if n > SAMPLE else rows
    x = np.array([r["x"] for r in picked.select("x").limit(2 * SAMPLE).collect()], np.int64)
    k = int(min(256, max(1, round((n / ROWS_A_CELL) ** 0.5))))
    cut = max(1, x.shape[1] // 2)
    index = Index((codebook(x[:, :cut], k, 1), codebook(x[:, cut:], k, 2)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                (i, r1), (j, r2) = index.cells(stacked(batch))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(r1), pa.array(r2)], ["vec_id", "label", "x", "i", "j", "r1", "r2"])

    celled = rows.mapInArrow(assign, CELL)
    data = written(celled.repartitionByRange(max(1, -(-n // TASK_ROWS)), "i", "j", "vec_id").sortWithinPartitions("i", "j"), "cells")
    for r in data.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"), F.max("r1").alias("r1"), F.max("r2").alias("r2")).collect():  # at most 256 x 256
        index.rows[r["i"], r["j"]] = r["n"]
        index.radii[0][r["i"]] = max(index.radii[0][r["i"]], r["r1"])
        index.radii[1][r["j"]] = max(index.radii[1][r["j"]], r["r2"])
    return data, index


def found(data: DataFrame, index: Index, wanted: Wanted) -> DataFrame:
    """The best rows of all windows."""
    shared = data.sparkSession.sparkContext.broadcast((index, wanted))
    hits = data.select("vec_id", "label", "x", "i", "j").mapInArrow(lambda b: search(b, *shared.value), FOUND)
    rank = F.row_number().over(Window.partitionBy("anchor", "win").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= wanted.k)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90), scale: int = 256, anchor_block: int = ANCHOR_BLOCK
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores.

    ``label`` is the label to go by; ``window`` holds the least and the greatest percentage of the
    positive's score that a negative's may have.
    """
    spark = vectors.sparkSession
    columns = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if label is not None:
        vectors = vectors.select("vec_id", label.alias("label"), "embedding")
    rows = written(usable(vectors, scale), "vectors")
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], columns)
    rows = rows.where(F.size("x") == lengths["d"])
    data, index = indexed(rows, lengths["n"])
    anchors = data.where(is_anchor)
    blocks = max(1, -(-2 * anchors.count() // anchor_block))
    out = None
    for b in range(blocks):
        asked = anchors.where(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)) == b).select("vec_id", "label", "x").orderBy("vec_id", "label", "x").collect()
        if not asked:
            continue
        part = block_negatives(data, index, asked, positives, negatives, window)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], columns)


def block_negatives(data: DataFrame, index: Index, asked: list, positives: int, negatives: int, window: tuple[int, int]) -> DataFrame:
    spark = data.sparkSession
    ids, labels, x = np.array([r["vec_id"] for r in asked]), np.array([r["label"] for r in asked]), np.array([r["x"] for r in asked], np.int64)
    one = Wanted(ids, labels, x, True, positives)
    one.probe(index)
    enough = found(data, index, one).groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low")).where(F.col("n") == positives)
    for r in enough.collect():  # a row for each anchor of the block at most
        one.low[r["anchor"]] = [r["low"]]
    one.certify()
    pairs = sorted((r["anchor"], r["rank"], r["vec_id"], r["score"]) for r in found(data, index, one).collect())  # positives of the block
    two = Wanted(ids, labels, x, False, negatives)
    two.low, two.high = [[] for _ in ids], [[] for _ in ids]
    named = []
    for anchor, _, positive, score in pairs:
        low, high = -(-window[0] * score // 100), window[1] * score // 100
        named.append((anchor, len(two.low[anchor]), int(ids[anchor]), positive, score))
        two.low[anchor].append(low), two.high[anchor].append(high)
    two.probe(index)
    enough = found(data, index, two).groupBy("anchor", "win").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low")).where(F.col("n") == negatives)
    for r in enough.collect():  # a row for each positive of the block at most
        two.low[r["anchor"]][r["win"]] = r["low"]
    two.certify()
    names = spark.createDataFrame(named, "anchor int, win int, anchor_id long, positive_id long, positive_score long")
    hits = found(data, index, two).join(F.broadcast(names), ["anchor", "win"])
    return hits.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
