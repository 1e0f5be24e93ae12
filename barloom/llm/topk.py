"""Exact top-k inner-product search by refined histograms of all scores.

Components become floor(scale * x). A block of queries of bounded size is broadcast; every task scores
its candidates against the block and counts the scores of each query in equal-width integer bins.
The summed histograms tell the bin with the k-th highest score; that bin is split again, until it is
one integer wide. A last pass keeps the scores above the k-th and, of those equal to it, the smallest
ids that are still needed, so a task sends at most k rows and its ties for each query.

Rows with a null or non-finite component, a null vector or a null id take no part. Vectors of other
lengths than a query's are not its candidates. Rows that share an id are each other's "own" row.
Fewer than k candidates: all of them. Rows with a component so great that a score could leave 64 bits
(length * component**2 >= 2**62 after scaling) take no part either. Other columns, of whatever name, are
left out; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import written

BINS = 256
QUERY_BLOCK = 8192  # queries of a block: what is broadcast is at most so many vectors
CANDIDATE_BLOCK = 4096  # vectors of a task, about: the work is theirs times the queries
SCORED = 4_000_000  # scores a task holds at once
HISTOGRAM = "qno int, bin int, n long"
HITS = "qno int, vec_id long, score long"


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and the integer components of every usable vector."""
    x = F.col("embedding").cast("array<double>")
    great = F.sqrt(F.lit(2.0**62) / F.greatest(F.size(x), F.lit(1)))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * F.lit(float(scale))) < great - 1))
    whole = F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("long")).alias("x")
    usable = F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & finite
    return vectors.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), whole)


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and integer matrix of each vector length in the batch."""
    ids = batch.column("vec_id").to_numpy()
    col = batch.column("x")
    sizes = np.diff(col.offsets.to_numpy())
    flat = col.flatten().to_numpy()
    ends = np.cumsum(sizes)
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        take = (ends[rows] - d)[:, None] + np.arange(d)
        yield ids[rows], flat[take]


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles while every sum stays below 2**53."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if top < 2**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


def scored(batches: Iterator[pa.RecordBatch], block: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Query numbers, candidate ids, their scores and which pairs count, block by block."""
    for batch in batches:
        if not batch.num_rows:
            continue
        for ids, x in matrices(batch):
            if x.shape[1] not in block:
                continue
            qno, qid, q = block[x.shape[1]]
            step = max(1, SCORED // max(1, len(ids)))
            for a in range(0, len(qno), step):
                s = slice(a, a + step)
                yield qno[s], ids, scores(q[s], x), qid[s][:, None] != ids[None, :]


def blocks_of(rows) -> dict:
    """Query numbers, ids and matrix of a collected block, by vector length."""
    out: dict = {}
    for r in rows:
        out.setdefault(len(r["x"]), []).append((r["qno"], r["vec_id"], r["x"]))
    return {d: (np.array([r[0] for r in v]), np.array([r[1] for r in v]), np.array([r[2] for r in v], np.int64)) for d, v in out.items()}


def top_k(vectors: DataFrame, is_query, k: int = 20, scale: int = 64, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` best candidates of each query row."""
    spark = vectors.sparkSession
    blocks = max(1, -(-vectors.count() // CANDIDATE_BLOCK))
    data = written(quantised(vectors, scale).repartition(blocks), "vectors")
    asked = data.where(is_query).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(max(1, -(-2 * data.where(is_query).count() // query_block)))))
    blocks = sorted(r["block"] for r in asked.groupBy("block").count().collect())
    out = None
    for b in blocks:
        rows = [r.asDict() | {"qno": i} for i, r in enumerate(asked.where(F.col("block") == b).orderBy("vec_id", "x").collect())]
        part = block_top_k(data, rows, k)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return out


def block_top_k(data: DataFrame, rows: list[dict], k: int) -> DataFrame:
    spark = data.sparkSession
    block = spark.sparkContext.broadcast(blocks_of(rows))
    n = len(rows)
    square = lambda v: F.pow(v.cast("double"), F.lit(2.0))
    norm = F.sqrt(F.aggregate(F.transform("x", square), F.lit(0.0), lambda a, v: a + v))
    longest = data.agg(F.max(norm).alias("m")).first()["m"] or 0.0
    asked = max(sum(v * v for v in r["x"]) for r in rows) ** 0.5
    reach = int(longest * asked * (1 + 1e-9)) + 2  # no inner product exceeds the product of the norms
    low = np.full(n, -reach, np.int64)  # the k-th score of query i lies in [low, low + width)
    width, need = 2 * reach, np.full(n, k, np.int64)  # need: its place from the top among those
    rounds = 0
    while width > 1:
        step = -(-width // BINS)
        state = spark.sparkContext.broadcast((low.copy(), step, width))

        def count(batches, state=state):
            low, step, width = state.value
            total: dict[int, np.ndarray] = {}
            for qno, _, s, ok in scored(batches, block.value):
                at = s - low[qno][:, None]
                ok &= (at >= 0) & (at < width)
                cell = at // step + np.arange(len(qno))[:, None] * BINS
                hist = np.bincount(cell[ok], minlength=len(qno) * BINS).reshape(-1, BINS)
                for i, q in enumerate(qno.tolist()):
                    if q in total:
                        total[q] += hist[i]
                    else:
                        total[q] = hist[i].copy()
            if total:
                q = np.array(list(total))
                h = np.stack(list(total.values()))
                i, j = np.nonzero(h)
                for a in range(0, len(i), 200_000):
                    s = slice(a, a + 200_000)
                    yield pa.RecordBatch.from_pydict({"qno": q[i[s]].astype(np.int32), "bin": j[s].astype(np.int32), "n": h[i[s], j[s]].astype(np.int64)})

        counted = data.mapInArrow(count, HISTOGRAM).groupBy("qno", "bin").agg(F.sum("n").alias("n"))
        above = F.sum("n").over(Window.partitionBy("qno").orderBy(F.desc("bin"))) - F.col("n")
        limits = spark.createDataFrame([(i, int(v)) for i, v in enumerate(need)], "qno int, need long")
        ranked = counted.withColumn("above", above).join(F.broadcast(limits), "qno")
        hit = ranked.where((F.col("above") < F.col("need")) & (F.col("above") + F.col("n") >= F.col("need")))
        found = hit.select("qno", "bin", "above").collect()  # a row for each query of the block at most
        seen = np.zeros(n, bool)
        for r in found:
            low[r["qno"]] += r["bin"] * step
            need[r["qno"]] -= r["above"]
            seen[r["qno"]] = True
        if rounds == 0:
            short = ~seen  # fewer than k candidates: every score is taken
        low[short] = -reach
        rounds, width = rounds + 1, step
    if rounds == 0:
        short = np.zeros(n, bool)
    last = spark.sparkContext.broadcast((low, need, short))

    def keep(batches):
        low, need, short = last.value
        pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for qno, ids, s, ok in scored(batches, block.value):
            best = ok & ((s > low[qno][:, None]) | short[qno][:, None])
            i, j = np.nonzero(best)
            pairs.append((qno[i], ids[j], s[i, j]))
            for i, j in grouped_ties(ok & (s == low[qno][:, None]) & ~short[qno][:, None], ids, need[qno]):
                pairs.append((qno[i], ids[j], s[i, j]))
        if pairs:
            q, v, s = (np.concatenate(x) for x in zip(*pairs))
            yield pa.RecordBatch.from_pydict({"qno": q.astype(np.int32), "vec_id": v, "score": s})

    hits = data.mapInArrow(keep, HITS)
    rank = F.row_number().over(Window.partitionBy("qno").orderBy(F.desc("score"), "vec_id")).alias("rank")
    names = spark.createDataFrame([(r["qno"], r["vec_id"]) for r in rows], "qno int, query_id long")
    best = hits.select("qno", "vec_id", "score", rank).where(F.col("rank") <= k)
    return best.join(F.broadcast(names), "qno").select("query_id", "rank", "vec_id", "score")


def grouped_ties(tied: np.ndarray, ids: np.ndarray, need: np.ndarray):
    """Of each query's tied candidates the ``need`` smallest ids."""
    order = np.argsort(ids, kind="stable")
    for i in np.flatnonzero(tied.any(axis=1)):
        j = order[tied[i, order]][:need[i]]
        yield np.full(len(j), i), j
