"""Toxicity of whole texts by a support vector machine with a subsequence string kernel.

A text is cut into sentences, a sentence into units: words between word marks, runs of single
characters joined (``i d i o t``), long words cut into overlapping windows. Words of two characters
are no units, nor are single ones outside a run of three or more. The kernel of two units sums, over
all subsequences of three characters that both hold and that span at most 8 characters in each,
``DECAY`` to the power of the length they span; it is normalised. So letters between an insult's
letters lower it but little, up to two in each gap; three or more in every gap leave no weight.

Training takes at most SAMPLE_DOCS labelled texts of each label. Units that toxic texts hold far beyond
chance are surely loud, also where a few clean texts quote them or are labelled wrong; such clean texts
are set aside. Landmarks are loud units and clean units, among them the most similar ones. At most
SAMPLE_UNITS distinct units of each label reach the machine. Nystroem features of a unit are its kernels
with the landmarks, whitened. A linear machine learns from witnesses: the highest unit of each toxic
text against all units of clean ones, chosen again in each round (multiple-instance learning). A
sentence scores as its highest unit, a text as its highest sentence; a logistic curve makes it 0..1.

The learned function of a unit is a sum over its subsequences, so it is folded into one table of
weights by subsequence, small enough to broadcast. Null and empty texts have the lowest score.
Without labels of both kinds, or a unit more frequent in toxic texts, all scores are 0. Characters
other than a-z and 0-9 share 26 codes. Whole texts are read, whatever their length; repeated rows are
rows of their own, and an empty table gives an empty result. Of other columns only ``kept`` keeps any.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import docs_of, fold, sigmoid, slices, texts_of, written

DECAY = 0.6
WINDOW, STEP = 20, 10  # characters of a unit's window
LANDMARKS = 256
SAMPLE_DOCS = 2000  # labelled documents of each label, at most, that training reads
SAMPLE_UNITS = 16_000  # distinct units that the machine sees of each label, at most
ROUNDS = 4
LOUD = 9  # times that a loud unit is more frequent in toxic than in clean texts, at least
LETTERS = 64  # codes of characters
SENTENCE = regex.compile(r"(?<=[.!?])\s+|\n+")
WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+(?:[\p{P}\p{S}]+[\p{L}\p{M}\p{N}]+)*")
INNER = regex.compile(r"[\p{P}\p{S}]+")
SCORED = "doc_id long, held_out boolean, score double, predicted int"
CUT = 0.3


def sentences(text: str) -> list[str]:
    return [s for s in SENTENCE.split(text) if s]


def units(sentence: str) -> list[str]:
    """Units of a sentence; punctuation inside a word is dropped."""
    out: list[str] = []
    singles = ""
    for word in sentence.lower().split():
        word = word.strip(".,;:!?()[]\"'|#$&%*-")
        if not word.isalnum():
            word = INNER.sub("", word)
        if len(word) == 1:
            singles += word
            continue
        if singles:
            if len(singles) > 2:
                out.append(singles)
            singles = ""
        if len(word) > 2:
            out.append(word)
    if len(singles) > 2:
        out.append(singles)
    return out


def windows(unit: str) -> list[str]:
    if len(unit) <= WINDOW:
        return [unit]
    return [unit[a:a + WINDOW] for a in range(0, len(unit) - WINDOW + STEP, STEP)]


@lru_cache(64)
def triples(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions i < j < k in n characters and the weight of their span."""
    i, j, k = (np.array(x) for x in zip(*((a, b, d) for a in range(n) for b in range(a + 1, n) for d in range(b + 1, min(n, a + 8)))))
    return i, j, k, DECAY ** (k - i - 2.0)


def coded(same_length: list[str]) -> np.ndarray:
    """Character codes between word marks, a row for each unit: letters, digits, and others folded into 26."""
    n = len(same_length[0])
    o = np.frombuffer("".join(same_length).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n).astype(np.int64)
    code = np.where((o >= 97) & (o <= 122), o - 97, np.where((o >= 48) & (o <= 57), o - 22, 36 + o % 26))
    return np.pad(code, ((0, 0), (1, 1)), constant_values=((0, 0), (62, 63)))


def features(same_length: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Subsequence codes (units x triples) and their weights, normalised, of units of one length."""
    codes = coded(same_length)
    i, j, k, w = triples(codes.shape[1])
    subs = (codes[:, i] * LETTERS + codes[:, j]) * LETTERS + codes[:, k]
    order = np.argsort(subs, axis=1, kind="stable")
    s = np.take_along_axis(subs, order, 1)
    run = np.cumsum(w[order], axis=1)
    last = np.concatenate([s[:, 1:] != s[:, :-1], np.ones((len(s), 1), bool)], axis=1)
    # the norm: a subsequence that comes twice counts with its summed weight
    ends = np.where(last, run, 0)
    before = np.maximum.accumulate(ends, axis=1)
    before = np.concatenate([np.zeros((len(s), 1)), before[:, :-1]], axis=1)
    norm = np.sqrt((np.where(last, run - before, 0) ** 2).sum(axis=1))
    return subs, w[None, :] / norm[:, None]


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        for a in range(0, len(at), 1000):
            part = at[a:a + 1000]
            yield part, [words[x] for x in part]


@dataclass
class Model:
    table: np.ndarray  # weight of each subsequence code
    bias: float
    slope: float  # of the logistic curve
    shift: float

    def margins(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words))
        for at, part in by_length(words):
            subs, weights = features(part)
            out[at] = (self.table[subs] * weights).sum(axis=1)
        return out + self.bias


NOTHING = -9.0  # margin of a text without units


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model, self.known = model, {}

    def texts(self, texts: list[str]) -> np.ndarray:
        """The highest unit's margin of each text."""
        cut = [units(t) for t in texts]
        if len(self.known) > 400_000:
            self.known.clear()
        new = [u for u in {u for us in cut for u in us} - self.known.keys()]
        short = [u for u in new if len(u) <= WINDOW]
        self.known.update(zip(short, self.model.margins(short).tolist()))
        for u in new:
            if len(u) > WINDOW:
                self.known[u] = float(self.model.margins(windows(u)).max())
        get = self.known.__getitem__
        return np.array([max(map(get, us), default=NOTHING) for us in cut])

    def scores(self, texts: list[str]) -> np.ndarray:
        return sigmoid(self.model.slope * self.texts(texts) + self.model.shift)


def text_units(text: str) -> list[list[str]]:
    return [[w for u in units(s) for w in windows(u)] for s in sentences(text)]


def linear_machine(phi: np.ndarray, rows: np.ndarray, y: np.ndarray, weight: np.ndarray, start: np.ndarray | None, c: float = 1e5) -> np.ndarray:
    """Squared hinge loss with an L2 penalty on rows of ``phi``, by Newton steps over those inside the margin."""
    d, cost, w = phi.shape[1] + 1, weight / weight.sum(), start
    blocks = range(0, len(rows), 2000)
    with_bias = lambda a: np.hstack([phi[rows[a:a + 2000]], np.ones((len(rows[a:a + 2000]), 1), phi.dtype)]).astype(np.float64)
    margins = lambda v: np.concatenate([y[a:a + 2000] * (with_bias(a) @ v) for a in blocks])
    active = np.ones(len(rows), bool) if w is None else margins(w) < 1
    for _ in range(12):
        left, right = np.eye(d) / c, np.zeros(d)
        for a in blocks:
            use = active[a:a + 2000]
            x, k = with_bias(a)[use], cost[a:a + 2000][use]
            left += 2 * (x * k[:, None]).T @ x
            right += 2 * x.T @ (k * y[a:a + 2000][use])
        w = np.linalg.solve(left, right)
        inside = margins(w) < 1
        if (inside == active).all():
            break
        active = inside
    return w


def kernels(words: list[str], landmarks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kernels of words with landmarks, and the landmarks' own weights: codes and codes x landmarks."""
    columns: dict[int, int] = {}
    cells: dict[tuple[int, int], float] = defaultdict(float)
    for m, u in enumerate(landmarks):
        subs, w = features([u])
        for code, x in zip(subs[0].tolist(), w[0].tolist()):
            cells[columns.setdefault(code, len(columns) + 1), m] += x
    dense = np.zeros((len(columns) + 1, len(landmarks)), np.float32)  # row 0: codes of no landmark
    for (i, m), x in cells.items():
        dense[i, m] = x
    index = np.zeros(LETTERS**3, np.int32)
    index[list(columns)] = list(columns.values())
    out = np.zeros((len(words), len(landmarks)), np.float32)
    for at, part in by_length(words):
        subs, w = features(part)
        where, w = index[subs], w.astype(np.float32)
        total = np.zeros((len(part), len(landmarks)), np.float32)
        for t in np.flatnonzero(where.any(axis=0)):
            total += dense[where[:, t]] * w[:, t, None]
        out[at] = total
    return out, np.array(list(columns)), dense[1:]


def loud_units(in_toxic: Counter, in_clean: Counter, toxic: int, clean: int) -> dict[str, int]:
    """Units whose texts are toxic far more often than chance would have it, the most frequent first.

    By chance no unit would reach its share of toxic texts (Chernoff's bound on the binomial tail
    under one in the number of units), and its rate in toxic texts is LOUD times that in clean ones,
    so some wrong labels or quotes in clean texts do not silence it. Where there is none, the five
    units with the highest smoothed odds stand in.
    """
    share = toxic / (toxic + clean)
    loud, odds = [], {}
    for u, n in in_toxic.items():
        other = in_clean[u]
        if n * clean < LOUD * other * toxic:
            if n * clean > other * toxic:
                odds[u] = (n + share) / (n + other + 1)
            continue
        odds[u] = (n + share) / (n + other + 1)
        at = n / (n + other)
        surprise = n * np.log(at / share) + (other * np.log((1 - at) / (1 - share)) if other else 0.0)
        if surprise > np.log(len(in_toxic)):
            loud.append(u)
    if not loud:
        loud = sorted(odds, key=lambda u: (-odds[u], -in_toxic[u], u))[:5]
    return {u: in_toxic[u] for u in sorted(loud, key=lambda u: (-in_toxic[u], u))}


def train(toxic: list[list[str]], clean: list[list[str]]) -> Model | None:
    """Units of the sampled texts' sentences; all choices are by counts and names, not at random."""
    if not toxic or not clean:
        return None
    in_toxic = Counter(u for t in toxic for u in set(t))
    in_clean = Counter(u for t in clean for u in set(t))
    sure = loud_units(in_toxic, in_clean, len(toxic), len(clean))
    if not sure:
        return None
    # Clean texts with a sure unit quote it or are labelled wrong: their units teach neither side.
    in_clean = Counter(u for t in clean if not any(u in sure for u in t) for u in set(t))
    sure = list(sure)
    only = {u: n for u, n in in_toxic.items() if not in_clean[u]}
    common = sorted(in_clean, key=lambda u: (-in_clean[u], u))[:SAMPLE_UNITS // 4]
    rare = sorted(in_clean, key=lambda u: hash_order(u))[:SAMPLE_UNITS * 3 // 4]
    negatives = list(dict.fromkeys([*common, *rare]))
    landmarks = list(dict.fromkeys([*sure[:LANDMARKS // 2], *common[:LANDMARKS // 8], *rare[:LANDMARKS // 8]]))
    rest = LANDMARKS - len(landmarks)
    near = kernels(negatives, sure[:LANDMARKS // 2])[0].max(axis=1)  # clean units most like a loud one
    landmarks = list(dict.fromkeys([*landmarks, *(negatives[i] for i in np.argsort(-near, kind="stable")[:rest])]))
    maybe = sorted(only, key=lambda u: (-only[u], u))[:SAMPLE_UNITS // 2]  # a bounded sample of possible witnesses
    vocabulary = [*maybe, *negatives]
    row = {u: i for i, u in enumerate(vocabulary)}
    kernel, codes, dense = kernels(vocabulary, landmarks)
    among, _, _ = kernels(landmarks, landmarks)
    values, vectors = np.linalg.eigh((among + among.T).astype(np.float64) / 2)
    whiten = vectors @ np.diag(np.maximum(values, 1e-3) ** -0.5) @ vectors.T
    whiten = whiten.astype(np.float32)
    phi = kernel @ whiten
    bags = [np.array([row[u] for u in set(t) if u in row and u in only], np.int64) for t in toxic]
    bags = [b for b in bags if len(b)]
    certain = np.array([row[u] for u in sure])
    held = np.sqrt(np.array([only[u] for u in maybe], float))
    yes, no, w = certain, np.arange(len(maybe), len(vocabulary)), None
    for turn in range(ROUNDS):
        y = np.concatenate([np.ones(len(yes)), -np.ones(len(no))])
        weight = np.concatenate([held[yes] / held[yes].sum(), np.full(len(no), 4 / len(no))])
        w = linear_machine(phi, np.concatenate([yes, no]), y, weight, w)
        if turn == 0:  # all other sampled clean units that look loud
            first = folded(codes, dense, whiten, w)
            others = sorted(in_clean.keys() - row.keys())
            high = first.margins(others)
            loud = [others[i] for i in np.argsort(-high, kind="stable")[:SAMPLE_UNITS // 2] if high[i] > -0.8]
            del others, high
            vocabulary += loud
            phi = np.vstack([phi, kernels(loud, landmarks)[0] @ whiten]) if loud else phi
        margin = phi @ w[:-1].astype(np.float32) + w[-1]
        no = np.arange(len(maybe), len(vocabulary))
        hard = no[(margin[no] > -0.6)]
        if len(hard):  # clean units that look loud count more in the next round
            no = np.concatenate([no, np.repeat(hard, max(1, len(no) // (2 * len(hard))))])
        witness = np.array([bag[margin[bag].argmax()] for bag in bags])
        yes = np.concatenate([certain, np.unique(witness[margin[witness] > 0])])
    model = folded(codes, dense, whiten, w)
    every = sorted({u for t in (*toxic, *clean) for u in t})
    margin_of = dict(zip(every, model.margins(every).tolist()))
    calibrate(model, *(np.array([max((margin_of[u] for u in t), default=NOTHING) for t in x]) for x in (toxic, clean)))
    return model


def folded(codes: np.ndarray, dense: np.ndarray, whiten: np.ndarray, w: np.ndarray) -> Model:
    """The machine's function as one weight for each subsequence."""
    table = np.zeros(LETTERS**3, np.float32)
    table[codes] = dense @ (whiten @ w[:-1])
    return Model(table, float(w[-1]), 1.0, 0.0)


def calibrate(model: Model, toxic: np.ndarray, clean: np.ndarray) -> None:
    """A logistic curve through the best threshold of the sampled texts, where the score is CUT."""
    edges = np.unique(np.concatenate([toxic, clean]))
    mids = (edges[1:] + edges[:-1]) / 2 if len(edges) > 1 else edges
    toxic, clean = np.sort(toxic), np.sort(clean)
    missed = np.searchsorted(toxic, mids) / len(toxic)
    wrong = 1 - np.searchsorted(clean, mids) / len(clean)
    cost = missed + 3 * wrong
    best = mids[cost <= cost.min() + 1e-12]
    model.slope = 6.0
    model.shift = float(np.log(CUT / (1 - CUT)) - model.slope * (best[0] + best[-1]) / 2)


def hash_order(word: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


def fit(docs: DataFrame, labels: DataFrame, training) -> Model | None:
    """Learn from a bounded sample of labelled rows that ``training`` (a column of doc_id) admits."""
    spark = docs.sparkSession
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & training).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    sample = None
    for kind in (0, 1):
        part = marked.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
        sample = part if sample is None else sample.unionByName(part)
    ids = spark.sparkContext.broadcast(dict(map(tuple, sample.collect())))  # 2 * SAMPLE_DOCS at most

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids_here = batch.column("doc_id").to_pylist()
            at = [i for i, d in enumerate(ids_here) if d in ids.value]
            texts = texts_of(batch)
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array([ids_here[i] for i in at], pa.int64()),
                "toxic": pa.array([ids.value[ids_here[i]] for i in at], pa.int32()),
                "units": pa.array([sorted({u for s in text_units(texts[i]) for u in s}) for i in at], pa.list_(pa.string())),
            })

    texts: tuple[list, list] = [], []
    same: dict[str, str] = {}  # one object for each distinct unit
    sampled = written(docs_of(docs).mapInArrow(split, "doc_id long, toxic int, units array<string>"), "units")  # one job for all texts
    for r in sampled.orderBy("doc_id", "toxic", "units").coalesce(1).toLocalIterator():  # the sample alone, in one order whatever the partitions
        texts[r["toxic"]].append([same.setdefault(u, u) for u in r["units"]])
    return train(texts[1], texts[0])


def scores_of(model: Model | None, texts: list[str], scorer: Scorer | None) -> np.ndarray:
    return scorer.scores(texts) if scorer else np.zeros(len(texts))


def scored(docs: DataFrame, model: Model | None, held_out) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value) if shared.value else None
        for batch in slices(batches):
            s = scores_of(shared.value, texts_of(batch), scorer)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= CUT).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"])

    return docs_of(docs, held_out.alias("held_out")).mapInArrow(score, SCORED)


def kept(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs``, all columns, that are not toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value) if shared.value else None
        for batch in slices(batches):
            yield batch.filter(pa.array(scores_of(shared.value, texts_of(batch), scorer) < CUT))

    return docs.mapInArrow(keep, docs.schema)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held_out = fold(F.col("doc_id"), 4) == 2
    return scored(docs, fit(docs, labels, ~held_out), held_out)
