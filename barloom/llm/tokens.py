"""Exact token ids of whole texts, with each distinct piece encoded by the library once.

Both vocabularies split a text before any merge, so a text may be cut where that split always
falls and the pieces encoded apart: at a blank or line end for ``word_bpe`` (white space is
dropped), and before a single blank or line end between two other characters for ``byte_bpe``
(white space stays with what follows it). A text with any other white space or with something like
a special token is encoded whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import pairwise

import numpy as np


CACHED_PIECES, CACHED_CHARS = 900_000, 20_000_000
TOGETHER = 1000  # pieces that the library encodes as one text

#: A word of letters that lower-case and split alike everywhere, and one mark that is always split off.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]?)\Z")


class Encoder:
    def __init__(self, vocabulary: str, most: int = CACHED_PIECES) -> None:
        self.most = most  # pieces kept in memory
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.blank_stays = vocabulary.startswith("byte")
        self.known: dict[str, bytes | None] = {}
        self.chars = 0
        self.marks: dict[str, bytes] = {}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        hidden = [b for b in range(256) if b not in set(printable)]
        self.letters = {b: chr(256 + k) for k, b in enumerate(hidden)}
        vocab = self.library.get_vocab()
        self.begins = np.zeros(max(vocab.values()) + 1, bool)  # tokens that begin with a blank or line end
        self.begins[[k for t, k in vocab.items() if t[:1] in (self.letters[32], self.letters[10])]] = True

    def whole(self, texts: Sequence[str]) -> list[bytes]:
        out = self.library.encode_batch_fast(list(texts), add_special_tokens=False)
        return [np.asarray(e.ids, "<u4").tobytes() for e in out]

    def pieces(self, text: str) -> list[str] | None:
        """The text cut at safe places, or None where it must stay whole."""
        if "<|" in text:
            return None
        if not self.blank_stays:
            return [p for p in text.replace("\n", " ").split(" ") if p]
        # "\0" marks the first piece; all others stand for themselves after a blank or as a line's begin
        return ("\0" + text.replace("\n", " \n")).split(" ") if "\0" not in text else None

    def safe(self, piece: str) -> bool:
        """Whether a piece of ``byte_bpe`` begins and ends as a cut piece must."""
        body = piece[1:] if piece[:1] == "\n" else piece
        return bool(body) and not body[0].isspace() and not body[-1].isspace()

    def word(self, word: str) -> bytes:
        """Ids of one split-off word of plain letters of ``word_bpe``: the library's model alone, on its byte letters."""
        body = word.lower()
        if not body.isascii():  # plain ASCII letters stand for their bytes
            body = body.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.library.model.tokenize(body)]).tobytes()

    def together(self, pieces: Sequence[str]) -> Iterator[bytes]:
        """Ids of safe pieces of ``byte_bpe`` that stand after others, many of them joined to one text.

        Their first character, a blank or line end, is nowhere else in them, so the tokens that begin with it begin a piece.
        """
        for a in range(0, len(pieces), TOGETHER):
            part = [self.shown(p) for p in pieces[a:a + TOGETHER]]
            ids = self.whole(["".join(part)])[0]
            starts = np.flatnonzero(self.begins[np.frombuffer(ids, "<u4")])
            if len(starts) == len(part) and starts[0] == 0:
                yield from (ids[x:y] for x, y in pairwise([*(4 * starts).tolist(), len(ids)]))
            else:  # not split as expected: each alone
                yield from self.whole(part)

    def learn(self, cut: Sequence[list[str] | None]) -> None:
        """Encode the pieces that are not known yet; None marks one that needs its whole text."""
        if len(self.known) > self.most or self.chars > CACHED_CHARS:
            self.known.clear()
            self.chars = 0
        known = self.known
        new = set().union(*filter(None, cut)).difference(known)
        self.chars += sum(map(len, new))
        words, marked, rest, first = set(), [], [], []
        for p in new:
            if m := PLAIN.match(p):
                stem, mark = m.groups()
                if stem not in known:
                    words.add(stem)
                if mark:
                    marked.append((p, stem, mark))
            elif not self.blank_stays:
                first.append(p)
            elif not self.safe(p.removeprefix("\0")):
                known[p] = None
            else:
                (first if p[0] == "\0" else rest).append(p)
        rest += words
        if self.blank_stays:
            known.update(zip(rest, self.together(rest)))
        else:
            known.update((p, self.word(p)) for p in rest)
        known.update((p, known[stem] + self.mark(mark)) for p, stem, mark in marked)
        known.update(zip(first, self.whole([self.shown(p) for p in first])))

    def shown(self, piece: str) -> str:
        """The characters that a piece stands for."""
        if not self.blank_stays or piece[:1] == "\n":
            return piece
        return piece[1:] if piece[:1] == "\0" else " " + piece

    def mark(self, mark: str) -> bytes:
        if mark not in self.marks:
            self.marks[mark] = self.whole([mark])[0]
        return self.marks[mark]

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        cut = [self.pieces(t) for t in texts]
        self.learn(cut)
        get, out, odd = self.known.__getitem__, [], []
        for k, ps in enumerate(cut):
            try:
                out.append(b"".join(map(get, ps)))
            except TypeError:  # not cut, or with a piece that must stay in its text
                out.append(b"")
                odd.append(k)
        for k, ids in zip(odd, self.whole([texts[k] for k in odd])):
            out[k] = ids
        return out

    def parts(self, texts: Sequence[str]) -> list[tuple[list[str], list[bytes]]]:
        """For each text its pieces and their ids; joined, they are the text's (``word_bpe``: without white space)."""
        cut = [self.pieces(t) for t in texts]
        self.learn(cut)
        get, out, odd = self.known.__getitem__, [], []
        for k, ps in enumerate(cut):
            ids = list(map(get, ps)) if ps else [None]
            if None in ids:
                odd.append(k)
            out.append(([self.shown(p) for p in ps or []], ids))
        for k, ids in zip(odd, self.whole([texts[k] for k in odd])):
            out[k] = ([texts[k]], [ids])
        return out


@lru_cache(None)
def encoder(vocabulary: str, most: int = CACHED_PIECES) -> Encoder:
    return Encoder(vocabulary, most)
