"""Counts by the recurrence alone; the start of the hidden Markov model."""

from __future__ import annotations

import random

import pytest

pytest.importorskip("tokenizers")

from barloom.llm import token_counts, tokens  # noqa: E402

BYTES = "byte_bpe_50k.json"


def test_counts_come_from_the_recurrence(monkeypatch):
    rng = random.Random(4)
    letters = "ab eé'sT\n\t 0 .,<|endoftext|>  日本🙂 \r\x00z"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(500)]
    texts += ["", "x" * 5000, " " * 900, "a<|endoftext|> b<|endoftext|>", "<|endoftext", "don't  stop\n\nnow \n end "]
    whole = [len(e) // 4 for e in tokens.encoder(BYTES).whole(texts)]

    def refused(*_):
        raise AssertionError("texts are not encoded for their counts")

    token_counts.counter(BYTES).known.clear()
    monkeypatch.setattr(tokens.Encoder, "whole", refused)
    monkeypatch.setattr(tokens.Encoder, "word", refused)
    got = [int(counts[-1]) if len(counts) else 0 for _, _, counts in token_counts.tables(texts, BYTES)]
    assert got == whole


def test_the_start_counts_the_neighbours_of_every_training_text(spark):
    """Pairs and first words of all texts, over the ends of batches and tasks, and none of a held-out one."""
    from barloom.llm import hidden_markov as hm

    texts = [f"a b{' c' * (k % 5)}" for k in range(3000)]
    rows = [(k, t, k % 10 == 0) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").repartition(7)
    train = [t for k, t, held in rows if not held]
    lex = hm.lexicon(hm.word_counts(docs.where("NOT held_out")), len(train))
    kinds = hm.kinds_of(lex)
    pairs, first = hm.neighbours(hm.encoded(docs, lex), kinds)
    at = lambda w: kinds[lex.head[w]]
    assert first[at(b"a")] == first.sum() == len(train)
    assert pairs[at(b"a"), at(b"b")] == len(train)
    assert pairs[at(b"c"), at(b"c")] == sum(max(0, t.count("c") - 1) for t in train)
    assert pairs[hm.KINDS - 1].sum() == 0  # nothing follows the end
    assert pairs.sum() == sum(len(t.split()) for t in train)
