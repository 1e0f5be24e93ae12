"""Byte-level BPE by rank tables: exact encoding with a segment tree, and decoding.

A text is cut by the vocabulary's pattern; each match is a word of bytes. If the word itself has a
rank, that is its only id. Else every byte is a live position, and a segment tree over the positions
keeps at each node the least ``rank * size + position`` of the pairs that begin below it, so the root
names the leftmost pair of least rank. A merge makes the pair one token, takes the second position out
and writes three leaves (the pair itself, the pair of the live neighbour to the left, the dead
position), each with logarithmic updates to the root. It ends when the root has no pair.

Short words are merged many at a time: their trees are rows of one array, and a step merges the root
pair of every unfinished word. Long ones have a tree of their own. Each worker remembers words and
blank-separated chunks within a bound.

Texts are cut into chunks before the pattern runs: at the begin of every run of white space that
follows another character, where a match always begins, because only a match's first character, or
all of its characters, may be white space.

Null texts count as empty and have no ids. Null ids of documents stay; repeated rows give repeated
results; every text is taken whole. Other columns, of whatever name, are left out. An empty table
gives an empty one. Unpaired surrogates cannot occur in a table's text. Ids without a rank make
``decode`` fail; a null list of ids decodes to null.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import docs_of, slices, texts_of

CACHED_WORDS, CACHED_CHUNKS, CACHED_CHARS = 600_000, 600_000, 12_000_000
LONGEST_CACHED = 256  # characters of a chunk or word that is remembered
SHORT = 64  # bytes: up to here words are merged many at a time
CELLS = 2_000_000  # leaves of the trees merged together
NONE = np.int64(2**62)
ENCODED = "doc_id long, ids array<int>"


class Pairs:
    """The rank of the concatenation of two tokens, by open addressing."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        left, right, rank = [], [], []
        for token, r in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(r)
        keys = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        self.mask = (1 << max(4, (4 * len(keys)).bit_length())) - 1
        self.keys = np.full(self.mask + 1, -1, np.int64)
        self.ranks = np.full(self.mask + 1, -1, np.int64)
        rank, at = np.array(rank, np.int64), self.slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] == -1)
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[at[put]], self.ranks[at[put]] = keys[put], rank[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, rank, at = keys[rest], rank[rest], (at[rest] + 1) & self.mask

    def slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(24)).astype(np.int64) & self.mask

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, -1 where there is none."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = self.slot(keys)
        seen = self.keys[at]
        out = np.where(seen == keys, self.ranks[at], -1)
        open_ = np.flatnonzero((seen != keys) & (seen != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            seen = self.keys[at[open_]]
            hit = seen == keys[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (seen != -1)]
        return out

    def one(self, left: int, right: int) -> int:
        key = left << 32 | right
        at = ((key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 24) & self.mask
        keys, ranks = self.listed
        while keys[at] != key:
            if keys[at] == -1:
                return -1
            at = (at + 1) & self.mask
        return ranks[at]

    @property
    def listed(self) -> tuple[list[int], list[int]]:
        if not hasattr(self, "_listed"):
            self._listed = self.keys.tolist(), self.ranks.tolist()
        return self._listed


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.match = regex.compile(pattern).findall
        self.chunk = regex.compile(r"\s*\S+|\s+").findall
        self.odd = regex.compile(r"[^\S ]|  |^ | $").search  # white space beyond single blanks inside
        self.pairs = Pairs(ranks)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        last = max(ranks.values())
        table: list[bytes | None] = [None] * (last + 1)
        for token, r in ranks.items():
            table[r] = token
        self.table = pa.array(table, pa.binary())
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.chars = 0

    def merge_many(self, words: Sequence[bytes], size: int) -> list[bytes]:
        """Ids of words of at most ``size`` bytes (a power of two), as little-endian 32-bit integers."""
        n, levels = len(words), size.bit_length() - 1
        lengths = np.fromiter(map(len, words), np.int64, n)
        raw = np.frombuffer(b"".join(w.ljust(size, b"\0") for w in words), np.uint8).reshape(n, size)
        place = np.arange(size)
        token = self.byte[raw]
        live = place[None, :] < lengths[:, None]
        after = np.broadcast_to(place + 1, (n, size)).copy()
        before = np.broadcast_to(place - 1, (n, size)).copy()
        tree = np.full((n, 2 * size), NONE, np.int64)
        both = live[:, :-1] & live[:, 1:]
        rank = self.pairs.of(token[:, :-1][both], token[:, 1:][both])
        tree[:, size:-1][both] = np.where(rank >= 0, rank * size + place[:-1][None, :].repeat(n, 0)[both], NONE)
        for k in range(levels - 1, -1, -1):
            a = 1 << k
            tree[:, a : 2 * a] = np.minimum(tree[:, 2 * a : 4 * a : 2], tree[:, 2 * a + 1 : 4 * a : 2])
        row = np.flatnonzero(tree[:, 1] < NONE)
        while len(row):
            rank, at = np.divmod(tree[row, 1], size)
            gone = after[row, at]
            right, left = after[row, gone], before[row, at]
            token[row, at] = rank
            live[row, gone] = False
            after[row, at] = right
            has_right, has_left = right < lengths[row], left >= 0
            before[row[has_right], right[has_right]] = at[has_right]
            tree[row, size + gone] = NONE
            self.put(tree, token, size, row, at, right, has_right)
            self.put(tree, token, size, row, left, at, has_left)
            rows, nodes = np.concatenate([row, row, row]), np.concatenate([at, gone, np.maximum(left, 0)]) + size
            for _ in range(levels):
                nodes >>= 1
                tree[rows, nodes] = np.minimum(tree[rows, 2 * nodes], tree[rows, 2 * nodes + 1])
            row = row[tree[row, 1] < NONE]
        ids = token[live].astype("<i4").tobytes()
        ends = 4 * np.cumsum(live.sum(axis=1))
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def put(self, tree, token, size, row, first, second, some) -> None:
        """The leaf of the pair (first, second), where there is a second."""
        leaf = np.full(len(row), NONE, np.int64)
        r, a, b = row[some], first[some], second[some]
        rank = self.pairs.of(token[r, a], token[r, b])
        leaf[some] = np.where(rank >= 0, rank * size + a, NONE)
        there = first >= 0
        tree[row[there], size + first[there]] = leaf[there]

    def merge_one(self, word: bytes) -> bytes:
        """The same for one long word."""
        n, none, rank_of = len(word), int(NONE), self.pairs.one
        size = 1 << (n - 1).bit_length()
        token = self.byte[np.frombuffer(word, np.uint8)]
        rank = self.pairs.of(token[:-1], token[1:])
        tree_ = np.full(2 * size, none, np.int64)
        tree_[size : size + n - 1] = np.where(rank >= 0, rank * size + np.arange(n - 1), none)
        a = size // 2
        while a:
            tree_[a : 2 * a] = np.minimum(tree_[2 * a : 4 * a : 2], tree_[2 * a + 1 : 4 * a : 2])
            a //= 2
        tree, token = tree_.tolist(), token.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while tree[1] < none:
            rank, at = divmod(tree[1], size)
            gone = after[at]
            right, left = after[gone], before[at]
            token[at], token[gone], after[at] = rank, -1, right
            leaves = [(gone, none), (at, none)]
            if right < n:
                before[right] = at
                r = rank_of(rank, token[right])
                leaves[1] = (at, r * size + at if r >= 0 else none)
            if left >= 0:
                r = rank_of(token[left], rank)
                leaves.append((left, r * size + left if r >= 0 else none))
            for p, leaf in leaves:
                node = size + p
                tree[node] = leaf
                while node > 1:
                    node >>= 1
                    low, high = tree[2 * node], tree[2 * node + 1]
                    low = low if low < high else high
                    if tree[node] == low:
                        break
                    tree[node] = low
        return np.array([t for t in token if t >= 0], "<i4").tobytes()

    def of_words(self, words: Sequence[str]) -> dict[str, bytes]:
        """Ids of each distinct word."""
        out: dict[str, bytes] = {}
        sizes: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            raw = w.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(raw)
            if whole is not None:
                out[w] = whole.to_bytes(4, "little")
            elif len(raw) > SHORT:
                out[w] = self.merge_one(raw)
            else:
                sizes.setdefault(1 << max(2, (len(raw) - 1).bit_length()), []).append((w, raw))
        for size, rows in sizes.items():
            step = CELLS // size
            for a in range(0, len(rows), step):
                part = rows[a : a + step]
                out.update(zip([w for w, _ in part], self.merge_many([r for _, r in part], size)))
        return out

    def cut(self, text: str) -> list[str]:
        """Chunks that join to the text, each the begin of a match; a chunk's first blank is left out.

        "\\0" marks a chunk that stands for itself, here and in a text of single blanks.
        """
        if not text:
            return []
        if "\0" not in text and not self.odd(text):
            return ("\0" + text).split(" ")
        return ["\0" + c for c in self.chunk(text)]

    def learn(self, cut: Sequence[list[str]]) -> dict[str, bytes]:
        """Ids of every chunk; long ones are not remembered."""
        if max(len(self.words) / CACHED_WORDS, len(self.chunks) / CACHED_CHUNKS, self.chars / CACHED_CHARS) > 1:
            self.words.clear(), self.chunks.clear()
            self.chars = 0
        new = [c for c in {c for cs in cut for c in cs} if c not in self.chunks]
        split = [self.match(c[1:] if c[:1] == "\0" else " " + c) for c in new]
        fresh = self.of_words([w for w in {w for ws in split for w in ws} if w not in self.words])
        long_words = {w: ids for w, ids in fresh.items() if len(w) > LONGEST_CACHED}
        self.words.update(fresh if not long_words else {w: ids for w, ids in fresh.items() if w not in long_words})
        known = self.words
        get = known.__getitem__ if not long_words else (lambda w: known[w] if w in known else long_words[w])
        long_chunks = {}
        for c, ws in zip(new, split):
            ids = b"".join(map(get, ws))
            (long_chunks if len(c) > LONGEST_CACHED else self.chunks)[c] = ids
        self.chars += sum(len(w) for w in fresh if len(w) <= LONGEST_CACHED) + sum(len(c) for c in new if len(c) <= LONGEST_CACHED)
        return long_chunks

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        cut = [self.cut(t) for t in texts]
        long_chunks = self.learn(cut)
        known = self.chunks
        if not long_chunks:
            return [b"".join(map(known.__getitem__, cs)) for cs in cut]
        return [b"".join([known[c] if c in known else long_chunks[c] for c in cs]) for cs in cut]

    def decode(self, ids: pa.ListArray) -> pa.BinaryArray:
        """The bytes that each list of ids stands for."""
        flat = ids.flatten()
        tokens = self.table.take(flat)
        if tokens.null_count:
            raise ValueError("an id has no token")
        tokens = tokens.cast(pa.large_binary())
        _, offsets, data = tokens.buffers()
        starts = np.frombuffer(offsets, np.int64)[tokens.offset : tokens.offset + len(tokens) + 1]
        sizes = np.where(ids.is_valid().to_numpy(zero_copy_only=False), ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        rows = starts[ends] if len(tokens) else np.zeros(len(ids) + 1, np.int64)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [pack(ids), pa.py_buffer(rows.tobytes()), data or pa.py_buffer(b"")]).cast(pa.binary())


def pack(ids: pa.ListArray) -> pa.Buffer | None:
    """The validity bits of the rows."""
    if not ids.null_count:
        return None
    return pa.py_buffer(np.packbits(ids.is_valid().to_numpy(zero_copy_only=False), bitorder="little").tobytes())


@lru_cache(None)
def codec(vocabulary: str) -> Codec:
    import public_tokenizers

    with open(public_tokenizers.path(vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return Codec(ranks, public_tokenizers.PATTERN)


def encode(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """doc_id and the ids of the whole text of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in slices(batches, 4_000_000):
            ids = own.encode(texts_of(batch))
            ends = np.cumsum([0, *(len(i) // 4 for i in ids)]).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), flat)], ["doc_id", "ids"])

    return docs_of(docs).mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """``encoded`` (doc_id, ids) with ``decoded``, the bytes that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in batches:
            ids = batch.column("ids").cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, own.decode(ids)], ["doc_id", "ids", "decoded"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, ENCODED + ", decoded binary")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the decimal ids and of the decoded bytes."""
    out = decode(encode(docs))
    text = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(text.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
