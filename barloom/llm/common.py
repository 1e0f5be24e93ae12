"""Helpers shared by the training-data operators: shared folders, folds, words, Arrow rows."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

CACHED_WORDS = 400_000
CACHED_CHARS = 8_000_000
BATCH_ROWS = 1000


def prepared(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches: whole texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder all executors share; a local one only on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-barloom-", dir="/tmp")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def docs_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and the named columns; all else, clashing names too, is left out."""
    text = F.coalesce(F.col("text").cast(StringType()), F.lit("")).alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, *more)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod n; null ids fall in fold 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(n)), F.lit(0))


def fold_of(doc_id: int | None, n: int) -> int:
    return 0 if doc_id is None else zlib.crc32(str(doc_id).encode()) % n


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [t or "" for t in batch.column(name).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most`` bytes of text (at least one row)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = np.array([len(t) if t else 0 for t in batch.column("text").to_pylist()], np.int64)
        part = np.cumsum(sizes) // most
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1), len(sizes)]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)


def partition_id() -> int:
    from pyspark import TaskContext

    ctx = TaskContext.get()
    return ctx.partitionId() if ctx else 0


class WordHashes:
    """64-bit hashes of white-space separated lower-case words, with a bounded memory."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0

    def of(self, words: Sequence[str]) -> np.ndarray:
        if len(self.known) > CACHED_WORDS or self.chars > CACHED_CHARS:
            self.known.clear()
            self.chars = 0
        new = set(words) - self.known.keys()
        self.chars += sum(map(len, new))
        self.known.update({w: xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in new})
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))

    def of_texts(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words and the offsets of the texts in them."""
        split = [t.lower().split() for t in texts]
        ends = np.cumsum([0, *map(len, split)])
        return self.of([w for s in split for w in s]), ends


def segment_sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``values`` between consecutive ``ends`` (empty segments: 0)."""
    out = np.zeros((len(ends) - 1, *values.shape[1:]), np.float64)
    full = np.diff(ends) > 0
    if full.any():
        out[full] = np.add.reduceat(values, ends[:-1][full], axis=0, dtype=np.float64)
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
