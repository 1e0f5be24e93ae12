"""Token counts of every prefix by dynamic programming, for budget and truncation questions.

A text's table has one entry for each piece (a word with the blank before it): the characters up to
its end and the tokens of the text up to there, a running sum over pieces. The tokens of a piece come
from the recurrence of byte-pair encodings on each word the library splits off: the last token t of
prefix j is the one suffix that leaves a compatible pair with the last token of prefix j - len(t), and
count(j) = count(j - len(t)) + 1. No text is encoded for ``n_tokens``; added tokens count one each.
Budgets are answered from the table.

Null texts are empty: 0 tokens. Repeated rows are counted alone, texts of any length whole. Other
columns, whatever their names, are left out. An empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barloom.llm.common import docs_of, slices, texts_of
from barloom.llm.tokens import CACHED_CHARS, CACHED_PIECES, encoder
from barloom.llm.tokens import PLAIN as PLAIN_AND_MARK

LIMIT = 512
COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long"
TABLE = "doc_id long, ends array<int>, counts array<int>"
SHIFT = 32  # a piece's characters lie below, its tokens above
NO_MERGE = 1 << 40
PLAIN = re.compile(r"[ ]?[A-Za-zÀ-ÖØ-öø-ÿ]+\Z")


class PrefixCounter:
    """Counts of the prefixes of one split-off word, by the last-token recurrence."""

    def __init__(self, vocabulary: str) -> None:
        import public_tokenizers

        with open(public_tokenizers.path(vocabulary), encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        added = sorted((t["content"] for t in whole["added_tokens"]), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {tuple(p): k for k, p in enumerate(pairs)}
        self.words = set(model["vocab"])
        self.longest = max(map(len, self.words))
        self.letters = encoder(vocabulary).letters
        self.joins: dict[tuple[str, str], bool] = {}
        self.split = encoder(vocabulary).library.pre_tokenizer.pre_tokenize_str
        self.known: dict[str, int | None] = {}  # pieces
        self.before = "", [0], [""]  # a word, its counts and last tokens
        self.chars = 0

    def merged(self, symbols: str) -> list[str]:
        parts, rank_of = list(symbols), self.rank.get
        while len(parts) > 1:
            ranks = [rank_of(pair, NO_MERGE) for pair in pairwise(parts)]
            least = min(ranks)
            if least == NO_MERGE:
                break
            best = ranks.index(least)
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        if (a, b) not in self.joins:
            if len(self.joins) > 500_000:
                self.joins.clear()
            self.joins[a, b] = self.merged(a + b) == [a, b]
        return self.joins[a, b]

    def byte_counts(self, word: str) -> list[int]:
        """count(j) of the first j bytes, j from 0."""
        return self.letter_counts(word.encode().decode("latin-1").translate(self.letters))

    def letter_counts(self, text: str) -> list[int]:
        """As ``byte_counts``, of a word in the vocabulary's byte letters; prefixes shared with the word before are not counted again."""
        before, count, last = self.before
        same = 0
        for a, b in zip(before, text):
            if a != b:
                break
            same += 1
        count, last = count[:same + 1], last[:same + 1]
        words, alone, joins = self.words, self.merged_alone, self.joins
        for j in range(same + 1, len(text) + 1):
            for i in range(max(0, j - self.longest), j):
                token = text[i:j]
                if token in words and alone(token):
                    fits = not i or joins.get((last[i], token))
                    if fits or fits is None and self.compatible(last[i], token):
                        count.append(count[i] + 1)
                        last.append(token)
                        break
        self.before = text, count, last
        return count

    @lru_cache(100_000)  # noqa: B019  one counter for each worker
    def word_tokens(self, letters: str) -> int:
        return self.letter_counts(letters)[-1]

    def tokens(self, text: str) -> int:
        """Tokens of a stretch of text that the library would split alike alone."""
        if PLAIN.match(text):  # one word
            return self.byte_counts(text)[-1]
        parts, n = [text], 0
        if self.added and "<" in text:
            parts = self.added.split(text)
            n = len(parts) - 1
        return n + sum(self.word_tokens(word) for part in parts if part for word, _ in self.split(part))

    def learn(self, cut: list[list[str] | None], enc) -> None:
        """Count the pieces that are not known yet, in order, so that words share prefixes with the word before; None marks one that needs its whole text.

        What is known of a piece is its tokens and the characters it stands for, as one number.
        """
        if len(self.known) > CACHED_PIECES or self.chars > CACHED_CHARS:
            self.known.clear()
            self.chars = 0
        known = self.known
        new = set().union(*filter(None, cut)).difference(known)
        self.chars += sum(map(len, new))
        for p in sorted(new):
            if m := PLAIN_AND_MARK.match(p):
                stem, mark = m.groups()
                n = known.get(stem) or known.setdefault(stem, self.byte_counts(" " + stem)[-1] << SHIFT | len(stem) + 1)
                known[p] = n + (self.word_tokens(mark) << SHIFT) + 1 if mark else n
            elif enc.safe(p.removeprefix("\0")):
                shown = enc.shown(p)
                known[p] = self.tokens(shown) << SHIFT | len(shown)
            else:
                known[p] = None

    @lru_cache(100_000)  # noqa: B019  one counter for each worker
    def merged_alone(self, token: str) -> bool:
        return self.merged(token) == [token]

    def char_counts(self, word: str) -> list[int]:
        """count of the first c characters, c from 0."""
        counts = self.byte_counts(word)
        ends = np.cumsum([0, *(len(ch.encode()) for ch in word)])
        return [counts[e] for e in ends]


@lru_cache(None)
def counter(vocabulary: str) -> PrefixCounter:
    return PrefixCounter(vocabulary)


def piece_counts(piece: str, vocabulary: str) -> list[int]:
    """Tokens of the first c characters of a piece, c from 0; other pieces than words ask the library."""
    if PLAIN.match(piece) and len(piece) <= 200:
        return counter(vocabulary).char_counts(piece)
    return [0, *(len(e) // 4 for e in encoder(vocabulary).whole([piece[:c] for c in range(1, len(piece) + 1)]))]


def tables(texts: list[str], vocabulary: str) -> list[tuple[list[str], np.ndarray, np.ndarray]]:
    """Pieces (as the encoder cuts them), character ends and token counts of each text at the end of each piece."""
    enc, dp, out = encoder(vocabulary), counter(vocabulary), []
    cuts = [enc.pieces(t) for t in texts]
    dp.learn(cuts, enc)
    for text, cut in zip(texts, cuts):
        known = list(map(dp.known.get, cut)) if cut else [None]
        if None in known:
            out.append((["\0" + text], np.array([len(text)]), np.array([dp.tokens(text)])))
            continue
        both = np.array(known, np.int64)
        out.append((cut, np.cumsum(both & (1 << SHIFT) - 1), np.cumsum(both >> SHIFT)))
    return out


def tokens_of_prefix(table: tuple[list[str], np.ndarray, np.ndarray], chars: int, vocabulary: str) -> int:
    """Exact tokens of the first ``chars`` characters."""
    pieces, ends, counts = table
    k = int(np.searchsorted(ends, chars, side="right"))
    done, tokens = (int(ends[k - 1]), int(counts[k - 1])) if k else (0, 0)
    return tokens if k >= len(pieces) or done == chars else tokens + piece_counts(encoder(vocabulary).shown(pieces[k])[:chars - done], vocabulary)[-1]


def fitting_prefix(table: tuple[list[str], np.ndarray, np.ndarray], budget: int, vocabulary: str) -> int:
    """Characters of the longest prefix that ends in the first piece to pass the budget, or before, and fits."""
    pieces, ends, counts = table
    k = int(np.searchsorted(counts, budget, side="right"))
    if k == len(pieces):
        return int(ends[-1]) if k else 0
    done, tokens = (int(ends[k - 1]), int(counts[k - 1])) if k else (0, 0)
    piece = encoder(vocabulary).shown(pieces[k])
    if len(piece) > 200:  # bisect: a whole text that could not be cut
        low, high = 0, len(piece)
        while low < high:
            mid = (low + high + 1) // 2
            fits = tokens + len(encoder(vocabulary).whole([piece[:mid]])[0]) // 4 <= budget
            low, high = (mid, high) if fits else (low, mid - 1)
        return done + low
    inside = piece_counts(piece, vocabulary)
    return done + max(c for c, n in enumerate(inside) if tokens + n <= budget)


def prefix_tables(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, ends, counts: the stored table of each text."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = tables(texts_of(batch), vocabulary)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"),
                pa.array([r[1] for r in rows], pa.list_(pa.int32())),
                pa.array([r[2] for r in rows], pa.list_(pa.int32())),
            ], ["doc_id", "ends", "counts"])

    return docs_of(docs).mapInArrow(build, TABLE)


def token_counts(docs: DataFrame, limit: int = LIMIT, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """Per document: bytes, tokens, whether over ``limit``, and the characters that fit the limit."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = texts_of(batch)
            rows = tables(texts, vocabulary)
            n = [int(r[2][-1]) if len(r[2]) else 0 for r in rows]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"),
                pa.array([len(t.encode()) for t in texts], pa.int64()),
                pa.array(n, pa.int64()),
                pa.array([k > limit for k in n], pa.bool_()),
                pa.array([fitting_prefix(r, limit, vocabulary) for r in rows], pa.int64()),
            ], ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    return docs_of(docs).mapInArrow(count, COUNTS)
