"""Language of whole texts by multinomial naive Bayes over hashed character n-grams.

Every word of letters, between word marks, gives its n-grams of 1 to 4 characters; an n-gram is
hashed into one of ``BUCKETS``. Training counts n-grams of each language in every task and sums them;
the log-probability matrix (buckets x languages) is broadcast, its size fixed by the parameters.
Scoring is sparse and by batch: the distinct words of a batch are scored once, and a text's log
probability is the sum over its words.

A null text or one without a letter is ``und`` with score 0. Rows with null text or lang teach
nothing; without any training rows every text is ``und``. Ties go to the first language by name.
Whole texts are read, whatever their length; repeated rows teach and are named each. An empty table
gives no rows. Other columns, whatever their names, are left out, but for ``kept``, which keeps all.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import docs_of, fold, slices, texts_of

BUCKETS, ORDERS, SMOOTHING = 1 << 15, (1, 2, 3, 4), 0.5
UNKNOWN = "und"
NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
LETTER = regex.compile(r"\p{L}")
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"


def words_of(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Lower-case words of letters of all texts, and each text's bounds in them; marks without any letter are no words."""
    split = [NOT_LETTERS.sub(" ", t.lower()).split() if LETTER.search(t) else [] for t in texts]
    return [w for s in split for w in s], np.cumsum([0, *map(len, split)])


def buckets_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each word (all words one after the other) and the word of each."""
    joined = np.frombuffer(("".join(f"\x01{w}\x02" for w in words)).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), sizes)
    grams, owners = [], []
    code = np.zeros(len(joined), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        k = len(joined) - n + 1
        if k <= 0:
            break
        code = (code[:k] * np.uint64(0x9E3779B97F4A7C15)) ^ (joined[n - 1:] + np.uint64(n))
        inside = owner[:k] == owner[n - 1:]
        if n in ORDERS:
            mixed = code * np.uint64(0xBF58476D1CE4E5B9)
            grams.append(((mixed ^ (mixed >> np.uint64(31))) >> np.uint64(7))[inside] % np.uint64(BUCKETS))
            owners.append(owner[:k][inside])
    if not grams:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(grams).astype(np.int64), np.concatenate(owners)


@dataclass
class Model:
    languages: list[str]
    log_prob: np.ndarray  # buckets x languages
    log_prior: np.ndarray


def fit(docs: DataFrame, training) -> Model:
    """Counts of all rows that ``training`` (a column) admits, summed over tasks and then in Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        rows: Counter[str] = Counter()
        for batch in slices(batches):
            langs, words = batch.column("lang").to_pylist(), {}
            for lang, text in zip(langs, texts_of(batch)):
                words.setdefault(lang, []).append(text)
            for lang, texts in words.items():
                tally = Counter(words_of(texts)[0])
                rows[lang] += len(texts)
                grams, owner = buckets_of(list(tally))
                weight = np.fromiter(tally.values(), np.float64, len(tally))[owner]
                add = np.bincount(grams, weight, BUCKETS)
                total[lang] = total[lang] + add if lang in total else add
        for lang, n in total.items():
            at = np.append(np.flatnonzero(n), BUCKETS)  # the last entry counts the rows
            yield pa.RecordBatch.from_pydict({
                "lang": [lang] * len(at), "bucket": at.astype(np.int32),
                "n": np.append(n[at[:-1]], rows[lang]).astype(np.int64),
            })

    teach = docs_of(docs, F.col("lang").cast("string").alias("lang")).where(training & F.col("lang").isNotNull() & (F.col("text") != ""))
    counts = teach.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    by_lang = counts.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("cells"))  # at most BUCKETS + 1 each
    found = sorted(by_lang.collect(), key=lambda r: r["lang"])
    matrix = np.zeros((BUCKETS + 1, len(found)))
    for j, r in enumerate(found):
        for cell in r["cells"]:
            matrix[cell["bucket"], j] = cell["n"]
    prior = matrix[BUCKETS]
    smooth = matrix[:BUCKETS] + SMOOTHING
    return Model([r["lang"] for r in found], np.log(smooth / smooth.sum(axis=0)), np.log(prior / max(prior.sum(), 1)))


class Scorer:
    """Scores texts; remembers the scores of a bounded number of words."""

    def __init__(self, model: Model) -> None:
        self.model, self.place, self.rows, self.used = model, {}, np.zeros((300_000, len(model.languages))), 0

    def matrix(self, words: list[str]) -> np.ndarray:
        new = list(set(words) - self.place.keys())
        if self.used + len(new) > len(self.rows):
            self.place, self.used = {}, 0
            new = list(set(words))
            if len(new) > len(self.rows):
                self.rows = np.zeros((len(new), self.rows.shape[1]))
        for a in range(0, len(new), 20_000):
            part = new[a:a + 20_000]
            grams, owner = buckets_of(part)
            at = slice(self.used + a, self.used + a + len(part))
            for j in range(self.rows.shape[1]):
                self.rows[at, j] = np.bincount(owner, self.model.log_prob[grams, j], len(part))
        self.place.update(zip(new, range(self.used, self.used + len(new))))
        self.used += len(new)
        return self.rows[np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        words, ends = words_of(texts)
        names, sure = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not words or not self.model.languages:
            return names, sure
        running = np.vstack([np.zeros(len(self.model.languages)), np.cumsum(self.matrix(words), axis=0)])
        logs = running[ends[1:]] - running[ends[:-1]] + self.model.log_prior
        share = np.exp(logs - logs.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        for i in np.flatnonzero(np.diff(ends) > 0):
            names[i], sure[i] = self.model.languages[best[i]], share[i, best[i]]
        return names, sure


def predicted(docs: DataFrame, model: Model, held_out) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in slices(batches):
            names, sure = scorer.predict(texts_of(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names), pa.array(sure)],
                ["doc_id", "held_out", "lang_pred", "score"])

    return docs_of(docs, held_out.alias("held_out")).mapInArrow(predict, PREDICTED)


def kept(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is found with a score of ``least`` at least."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in slices(batches):
            names, sure = scorer.predict(texts_of(batch))
            yield batch.filter(pa.array([n != UNKNOWN and s >= least for n, s in zip(names, sure)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def digest(docs: DataFrame) -> DataFrame:
    held_out = fold(F.col("doc_id"), 3) == 1
    return predicted(docs, fit(docs, ~held_out), held_out)
