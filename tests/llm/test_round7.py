"""Cases of the seventh round: tokens are counted and encoded with less work, and come out the same."""

from __future__ import annotations

import numpy as np

from barloom.llm import token_counts, tokens

BYTES = "byte_bpe_50k.json"
ODD = ["", "\n", "a b", "Foo, foo... foo$$$ don't\nnew line 123 x_y", "  two", "tab\there", "a \n\nb", "\0 zero", "Über größe,*** 漢字 🙂!", "Ġ Ċ …x", "<|endoftext|> a"]


class Asked(set):
    """A set that remembers what was looked up."""

    def __contains__(self, x):
        self.seen.append(x)
        return super().__contains__(x)


def test_prefix_of_the_word_before_is_not_counted_again():
    counter = token_counts.PrefixCounter(BYTES)
    counter.words = Asked(counter.words)
    counter.words.seen = []
    first = counter.letter_counts("Ġwork")
    counter.words.seen.clear()
    second = counter.letter_counts("Ġworkzq")
    assert counter.words.seen and all(set("zq") & set(t) for t in counter.words.seen)
    assert second[:6] == first and counter.letter_counts("Ġwo") == first[:4]


def test_words_are_not_encoded_one_by_one(monkeypatch):
    """Many new words go to the library as one text, and the ids are those of whole texts."""
    enc = tokens.Encoder(BYTES)
    monkeypatch.setattr(enc, "word", lambda word: 1 / 0)
    texts = [*ODD, " ".join(f"w{chr(97 + k % 26)}rd{'xyz'[k % 3] * (k % 7)}" for k in range(3000))]
    got = [np.frombuffer(ids, "<u4").tolist() for ids in enc.encode(texts)]
    assert got == [enc.library.encode(t, add_special_tokens=False).ids for t in texts]


def test_counts_and_ends_of_odd_texts():
    lib = tokens.encoder(BYTES).library
    for text, (_, ends, counts) in zip(ODD, token_counts.tables(ODD, BYTES)):
        assert (ends[-1], counts[-1]) == (len(text), len(lib.encode(text, add_special_tokens=False).ids))
