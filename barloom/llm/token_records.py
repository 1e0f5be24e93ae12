"""Length-delimited binary records of token ids, with a separate offset index.

A part file is a run of frames, in ascending document order::

    length u64 | masked crc32 of those 8 bytes u32 | payload | masked crc32 of the payload u32

A payload is ``doc_id i64 | flags u8 | n_tokens u64 | zstd of n_tokens little-endian ids`` (2 bytes
an id, or 4 with flag 2; flag 1: null doc_id). A part's index file has one entry of two u64 for each
record: the frame's byte offset and its number of tokens. The manifest, a Parquet table, lists the
parts that count, so that a file left by a lost or repeated task is never read.

Null texts are empty texts; null ids come first; equal ids are ordered by text. An empty table gives
a manifest without parts. Other columns are left out.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.common import docs_of, partition_id, shared_path, slices, texts_of
from barloom.llm.tokens import encoder

# Fixed value: the mask added to rotated checksums by the common framed record format.
MASK_DELTA = 0xA282EAD8
KNOWN_PIECES = 1_300_000  # encoded pieces that a worker remembers; fits the slots of a dict of 900,000
HEAD, META, ENTRY = "<QI", "<qBQ", "<QQ"
HEAD_SIZE, META_SIZE = struct.calcsize(HEAD), struct.calcsize(META)
MANIFEST = "part long, file string, n_docs long, n_tokens long"
RECORDS = "part long, place long, doc_id long, start long, n_tokens long, ids binary"


class RecordError(ValueError):
    """A frame does not match its length or checksums."""


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload))


def pack_payload(doc_id: int | None, ids: np.ndarray, squeeze: zstandard.ZstdCompressor) -> bytes:
    wide = len(ids) > 0 and int(ids.max()) > 0xFFFF
    body = ids.astype("<u4" if wide else "<u2").tobytes()
    return struct.pack(META, doc_id or 0, (doc_id is None) + 2 * wide, len(ids)) + squeeze.compress(body)


def unpack_payload(payload: bytes, expand: zstandard.ZstdDecompressor) -> tuple[int | None, np.ndarray]:
    doc_id, flags, n = struct.unpack_from(META, payload)
    size = 4 if flags & 2 else 2
    body = expand.decompress(payload[META_SIZE:], max_output_size=max(1, n * size))
    return None if flags & 1 else doc_id, np.frombuffer(body, f"<u{size}").astype("<u4")


def read_frame(data: memoryview, at: int) -> tuple[bytes, int]:
    """The payload of the frame at ``at`` and where the next one begins; raises RecordError."""
    if at + HEAD_SIZE > len(data):
        raise RecordError("cut off in a frame's head")
    length, check = struct.unpack_from(HEAD, data, at)
    if masked(bytes(data[at:at + 8])) != check:
        raise RecordError("wrong checksum of a length")
    begin = at + HEAD_SIZE
    end = begin + length
    if end + 4 > len(data):
        raise RecordError("cut off in a payload")
    payload = bytes(data[begin:end])
    if struct.unpack_from("<I", data, end)[0] != masked(payload):
        raise RecordError("wrong checksum of a payload")
    return payload, end + 4


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def write_records(docs: DataFrame, path: str, vocabulary: str = "word_bpe_49k.json", end_id: int = 1) -> DataFrame:
    """Encode every text, append ``end_id``, write the part files under ``path``; returns the manifest.

    One shuffle, of the texts, by ranges of doc_id; a range is sorted, encoded and written by its task.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, squeeze = encoder(vocabulary, KNOWN_PIECES), zstandard.ZstdCompressor(level=1)
        part, n_docs, n_tokens, at = partition_id(), 0, 0, 0
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        store = out = index = None
        for batch in slices(batches):
            if out is None:
                store, folder = open_store(path)
                store.create_dir(folder, recursive=True)
                out = store.open_output_stream(f"{folder}/{name}.rec", compression=None)
                index = store.open_output_stream(f"{folder}/{name}.idx", compression=None)
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), coder.encode(texts_of(batch))):
                tokens = np.append(np.frombuffer(ids, "<u4"), np.uint32(end_id))
                framed = frame(pack_payload(doc_id, tokens, squeeze))
                out.write(framed)
                index.write(struct.pack(ENTRY, at, len(tokens)))
                at += len(framed)
                n_docs, n_tokens = n_docs + 1, n_tokens + len(tokens)
        if out is not None:
            out.close()
            index.close()
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int64()), "file": [name],
                "n_docs": pa.array([n_docs], pa.int64()), "n_tokens": pa.array([n_tokens], pa.int64()),
            })

    ordered = docs_of(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{path}/manifest")
    return read_manifest(docs.sparkSession, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def read_records(manifest: DataFrame, path: str, shuffle_seed: int | None = None) -> DataFrame:
    """All records of the parts; with a seed each part is read in a random order through its index.

    ``start``: the ids of all documents before. The running sum is over parts, one small row each.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            for part, name, base in zip(*(batch.column(c).to_pylist() for c in ("part", "file", "base"))):
                store, folder = open_store(path)
                with store.open_input_stream(f"{folder}/{name}.idx", compression=None) as f:
                    entries = np.frombuffer(f.read(), "<u8").reshape(-1, 2)
                starts = base + np.cumsum(entries[:, 1]) - entries[:, 1]
                order = np.arange(len(entries))
                if shuffle_seed is not None:
                    order = np.random.default_rng([shuffle_seed, part]).permutation(order)
                with store.open_input_file(f"{folder}/{name}.rec") as f:
                    size = f.size()
                    edges = np.append(entries[:, 0], size).astype(np.int64)
                    for group in np.array_split(order, max(1, size // 2_000_000)):
                        rows = []
                        for k in group.tolist():
                            f.seek(int(edges[k]))
                            payload, _ = read_frame(memoryview(f.read(int(edges[k + 1] - edges[k]))), 0)
                            doc_id, ids = unpack_payload(payload, expand)
                            if len(ids) != entries[k, 1]:
                                raise RecordError("index and record differ in length")
                            rows.append((part, k, doc_id, int(starts[k]), len(ids), ids.tobytes()))
                        names = [x.split()[0] for x in RECORDS.split(", ")]
                        kinds = [pa.int64()] * 5 + [pa.binary()]
                        cols = list(zip(*rows)) if rows else [()] * 6
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base")
    parts = max(1, manifest.count())
    return manifest.select("part", "file", base).repartition(parts, "part").mapInArrow(read, RECORDS)


def digest(docs: DataFrame) -> DataFrame:
    """Write, read back, and describe each record: doc_id, start, n_tokens, ids_crc32."""
    path = shared_path(docs.sparkSession, "token-records")
    manifest = write_records(docs, path)
    return read_records(manifest, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
