"""Hidden Markov language model: Baum-Welch over all training texts, exact scoring of all texts.

Tokens are the words of a text in bytes (A-Z lowered, cut at blanks and control white space) and one
end. The HEAD most frequent training words are symbols of their own; any other word is emitted as one
of TAILS classes, chosen by its last two bytes, times its share within the class:
(c + 0.1) / (N_class + 0.1 (V_class + 1)). So the states' tables have a fixed size, which is what is
broadcast, while counts and shares cover every word of the corpus.

Expected counts of states, transitions and emissions are made in every task by scaled forward and
backward recursions, many texts in step, and summed in Spark; ITERATIONS passes over all training
texts follow a start from the counts of neighbours in all of them (KINDS x KINDS). The score is log10 of the scaled forward recursion's
likelihood times the shares of the tail words, which come from a join with the word counts.

Null and empty texts have the end alone. A training set without rows gives a uniform model: c = 0,
N = 0, V = 0 leave the base at log10(1) for each token. Repeated rows count each time. An empty table
gives no rows; other columns, whatever their names, are left out. Start, counts, passes and
scores read all texts whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import docs_of, fold, partition_id, slices, texts_of, written

STATES, HEAD, TAILS = 8, 40_000, 64
ITERATIONS, START_ITERATIONS = 2, 60
KINDS = 512  # words of their own, tail classes and the end in the pair counts of the start
SMOOTH = 0.1  # of unigram shares, as in the base
EMISSION_SMOOTH = 20.0  # pseudo-counts of a state's emissions, spread by the unigram shares
TOGETHER = 192  # texts recursed in step
SALTS = 32  # partial sums of a table's block before the last sum
FLUSH = 200_000  # distinct words a task holds before it passes their counts on


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def tail_class(word: bytes) -> int:
    return (word[-1] * 31 + (word[-2] if len(word) > 1 else 0)) % TAILS


def word_counts(docs: DataFrame) -> DataFrame:
    """word, c over the rows of ``docs``; partial counts are made in the tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter[bytes] = Counter()
        flushed = lambda: pa.RecordBatch.from_arrays([pa.array(list(tally), pa.binary()), pa.array(list(tally.values()), pa.int64())], ["word", "c"])
        for batch in slices(batches):
            for text in texts_of(batch):
                tally.update(words_of(text))
            if len(tally) > FLUSH:
                yield flushed()
                tally.clear()
        if tally:
            yield flushed()

    return docs.mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Lexicon:
    """Symbols: head words, then tail classes, then the end."""

    head: dict[bytes, int]
    counts: np.ndarray  # of the symbols
    total: int  # N
    distinct: int  # V
    class_total: np.ndarray
    class_distinct: np.ndarray

    @property
    def size(self) -> int:
        return len(self.head) + TAILS + 1

    def symbols(self, text: str) -> tuple[np.ndarray, Counter]:
        """Symbol numbers of a text with its end, and its tail words."""
        words = words_of(text)
        got = list(map(self.head.get, words))
        tail: Counter[bytes] = Counter()
        if None in got:
            base = len(self.head)
            for i, g in enumerate(got):
                if g is None:
                    tail[words[i]] += 1
                    got[i] = base + tail_class(words[i])
        got.append(self.size - 1)
        return np.array(got, np.int32), tail


def lexicon(counts: DataFrame, texts: int) -> Lexicon:
    """The head (bounded) and the totals of the tail classes."""
    step = F.floor(F.log2("c") * 16).cast("int")  # counts in steps of about 4 percent: some hundred at most
    sizes = sorted(((r["step"], r["n"]) for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
    reach = next((k for k, n in zip((k for k, _ in sizes), accumulate(n for _, n in sizes)) if n >= HEAD), 0)
    often = counts.where(step >= reach)  # the head and the rest of its last step: no task sends more
    head = [(bytes(r["word"]), r["c"]) for r in often.orderBy(F.desc("c"), "word").limit(HEAD).collect()]
    border = (head[-1][1], head[-1][0]) if len(head) == HEAD else None
    last = F.conv(F.hex(F.expr("substr(word, -1, 1)")), 16, 10).cast("int")
    prior = F.when(F.length("word") > 1, F.conv(F.hex(F.expr("substr(word, length(word) - 1, 1)")), 16, 10).cast("int")).otherwise(0)
    tail = counts
    if border:
        tail = counts.where((F.col("c") < border[0]) | ((F.col("c") == border[0]) & (F.col("word") > F.lit(bytearray(border[1])))))
    else:
        tail = counts.where(F.lit(False))
    by_class = tail.groupBy(((last * 31 + prior) % TAILS).alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()
    total, distinct = np.zeros(TAILS), np.zeros(TAILS)
    for r in by_class:
        total[r["k"]], distinct[r["k"]] = r["c"], r["v"]
    n = sum(c for _, c in head) + int(total.sum()) + texts
    v = len(head) + int(distinct.sum()) + (texts > 0)
    return Lexicon({w: i for i, (w, _) in enumerate(head)}, np.array([*(c for _, c in head), *total, texts], float), n, v, total, distinct)


def encoded(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """Symbols of every text and its tail words, written once."""
    shared = docs.sparkSession.sparkContext.broadcast(lex)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, row = shared.value, partition_id() << 40
        for batch in slices(batches):
            found = [lex.symbols(t) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(row, row + len(found))), batch.column("doc_id"), batch.column("held_out"),
                pa.array([f[0] for f in found], pa.list_(pa.int32())),
                pa.array([list(f[1].items()) for f in found], pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))),
            ], ["row", "doc_id", "held_out", "symbols", "tail"])
            row += len(found)

    schema = "row long, doc_id long, held_out boolean, symbols array<int>, tail array<struct<word: binary, n: bigint>>"
    return written(docs.mapInArrow(encode, schema), "symbols")


@dataclass
class Model:
    initial: np.ndarray  # states
    transition: np.ndarray  # states x states
    emission: np.ndarray  # symbols x states


def in_step(lists: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and a (step, text) matrix of texts of like length; -1 after the end."""
    order = np.argsort([-len(x) for x in lists], kind="stable")
    at = 0
    while at < len(order):
        longest = len(lists[order[at]])
        part = order[at:at + max(8, min(TOGETHER, 2_000_000 // longest))]
        at += len(part)
        grid = np.full((longest, len(part)), -1, np.int32)
        for j, i in enumerate(part):
            grid[:len(lists[i]), j] = lists[i]
        yield part, grid


def forward(model: Model, grid: np.ndarray, keep: bool = False):
    """log10 likelihood of each column; with ``keep`` also the scaled forward values and the scales.

    Columns are ordered from the longest, so those still running are always the first ones.
    """
    live = (grid >= 0).sum(axis=1)
    logs = np.zeros(grid.shape[1])
    alphas, scales = [], []
    a = None
    for t in range(len(grid)):
        n = live[t]
        e = model.emission[grid[t, :n]]
        a = model.initial * e if t == 0 else (a[:n] @ model.transition) * e
        s = a.sum(axis=1)
        a /= s[:, None]
        logs[:n] += np.log10(s)
        if keep:
            alphas.append(a)
            scales.append(s)
    return (logs, alphas, scales) if keep else logs


class Tally:
    """Expected counts of one pass."""

    def __init__(self, symbols: int, states: int) -> None:
        self.initial, self.transition = np.zeros(states), np.zeros((states, states))
        self.emission = np.zeros((symbols, states))

    def add(self, model: Model, lists: list[np.ndarray]) -> None:
        k = len(model.initial)
        for _, grid in in_step(lists):
            _, alphas, scales = forward(model, grid, keep=True)
            live = (grid >= 0).sum(axis=1)
            gammas = [None] * len(grid)
            beta = np.ones((live[-1], k))
            for t in range(len(grid) - 1, -1, -1):
                n = live[t]
                if n > len(beta):
                    beta = np.vstack([beta, np.ones((n - len(beta), k))])
                gammas[t] = alphas[t] * beta
                if t:
                    eb = model.emission[grid[t, :n]] * beta / scales[t][:, None]
                    self.transition += model.transition * (alphas[t - 1][:n].T @ eb)
                    beta = eb @ model.transition.T
            self.initial += gammas[0].sum(axis=0)
            gamma, symbol = np.concatenate(gammas), grid[grid >= 0]
            for j in range(k):
                self.emission[:, j] += np.bincount(symbol, gamma[:, j], len(self.emission))


def improved(tally: Tally, share: np.ndarray) -> Model:
    emission = tally.emission + EMISSION_SMOOTH * share[:, None]
    transition = tally.transition + 0.1
    initial = tally.initial + 0.1
    return Model(initial / initial.sum(), transition / transition.sum(axis=1, keepdims=True), emission / emission.sum(axis=0))


def kinds_of(lex: Lexicon) -> np.ndarray:
    """Kind of every symbol for the start: the KINDS - TAILS - 1 most frequent words, tail classes, the end."""
    own = KINDS - TAILS - 1
    head = [i if i < own else own + tail_class(w) for i, w in enumerate(lex.head)]
    return np.array([*head, *range(own, own + TAILS), KINDS - 1], np.int32)


def neighbours(data: DataFrame, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First kinds and counts of kinds next to each other, over all training texts."""
    shared = data.sparkSession.sparkContext.broadcast(kinds)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, pairs, first = shared.value, np.zeros(KINDS * KINDS, np.int64), np.zeros(KINDS, np.int64)
        for batch in batches:
            col = batch.column("symbols")
            ends = col.offsets.to_numpy()
            flat = kinds[col.flatten().to_numpy()]
            begins = ends[:-1] - ends[0]
            inside = np.ones(max(0, len(flat) - 1), bool)
            inside[begins[1:] - 1] = False  # from one text to the next
            pairs += np.bincount((flat[:-1] * KINDS + flat[1:])[inside], minlength=KINDS * KINDS)
            first += np.bincount(flat[begins], minlength=KINDS)
        rows = np.vstack([pairs.reshape(KINDS, KINDS), first])
        at = np.flatnonzero(rows.any(axis=1)).astype(np.int32)
        yield pa.RecordBatch.from_pydict({"kind": pa.array(at, pa.int32()), "sums": pa.array([rows[k].tobytes() for k in at], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, kind = None, None
        for batch in batches:
            for k, b in zip(batch.column("kind").to_pylist(), batch.column("sums").to_pylist()):
                x = np.frombuffer(b, np.int64)
                kind, total = k, x if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_pydict({"kind": pa.array([kind], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    made = data.where(~F.col("held_out")).select("symbols").mapInArrow(count, "kind int, sums binary")
    rows = np.zeros((KINDS + 1, KINDS), np.int64)
    for r in made.groupBy("kind").applyInArrow(add, made.schema).collect():  # KINDS + 1 rows at most
        rows[r["kind"]] = np.frombuffer(r["sums"], np.int64)
    return rows[:-1].astype(float), rows[-1].astype(float)


def started(data: DataFrame, lex: Lexicon, share: np.ndarray) -> Model:
    """A first model from the neighbours of all training texts: Baum-Welch on the counts of pairs of kinds.

    Words of a kind share its emission by their frequency; the passes of ``baum_welch`` part them.
    """
    kinds = kinds_of(lex)
    pairs, first = neighbours(data, kinds)
    spread = np.bincount(kinds, share, KINDS)  # shares of the kinds
    rng = np.random.default_rng(11)
    emission = spread[:, None] * rng.uniform(0.5, 1.5, (KINDS, STATES))
    transition = 0.6 * np.eye(STATES) + 0.4 * rng.dirichlet(np.ones(STATES), STATES)
    emission, before = emission / emission.sum(axis=0), np.full(STATES, 1 / STATES)
    for _ in range(START_ITERATIONS if pairs.any() else 0):
        left = emission * before  # kind and state of the first of a pair
        weight = np.divide(pairs, left @ transition @ emission.T, out=np.zeros_like(pairs), where=pairs > 0)
        one = left * (weight @ emission @ transition.T)
        two = emission * (weight.T @ left @ transition)
        moved = transition * (left.T @ weight @ emission) + 0.1
        emission = one + two + EMISSION_SMOOTH * spread[:, None]
        emission, transition = emission / emission.sum(axis=0), moved / moved.sum(axis=1, keepdims=True)
        before = (one.sum(axis=0) + 0.1) / (one.sum() + 0.1 * STATES)
    like = emission * before
    total = like.sum(axis=1, keepdims=True)
    initial = (first[:, None] * np.divide(like, total, out=np.zeros_like(like), where=total > 0)).sum(axis=0) + 0.1
    full = emission[kinds] * np.divide(share, spread[kinds], out=np.zeros_like(share), where=spread[kinds] > 0)[:, None]
    return Model(initial / initial.sum(), transition, full / full.sum(axis=0))


def baum_welch(data: DataFrame, model: Model, share: np.ndarray) -> Model:
    """One pass over all training texts."""
    shared = data.sparkSession.sparkContext.broadcast(model)
    size, block = len(share), 4096

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(size, STATES)
        for batch in batches:
            tally.add(shared.value, lists_of(batch))
        rows = np.vstack([tally.emission, tally.transition, tally.initial[None, :]])
        parts = [rows[a:a + block].tobytes() for a in range(0, len(rows), block)]
        yield pa.RecordBatch.from_pydict({"part": pa.array(range(len(parts)), pa.int32()), "salt": pa.array([partition_id() % SALTS] * len(parts), pa.int32()), "sums": pa.array(parts, pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = None, None
        for batch in batches:
            for p, b in zip(batch.column("part").to_pylist(), batch.column("sums").to_pylist()):
                x = np.frombuffer(b, np.float64)
                part, total = p, x if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "salt": pa.array([0], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    made = data.where(~F.col("held_out")).select("symbols").mapInArrow(expect, "part int, salt int, sums binary")
    fewer = made.groupBy("part", "salt").applyInArrow(add, made.schema)
    summed = fewer.groupBy("part").applyInArrow(add, made.schema).collect()  # as large as the model
    rows = np.concatenate([np.frombuffer(r["sums"], np.float64) for r in sorted(summed, key=lambda r: r["part"])]).reshape(-1, STATES)
    tally = Tally(size, STATES)
    tally.emission, tally.transition, tally.initial = rows[:size], rows[size:-1], rows[-1]
    return improved(tally, share)


def lists_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    col = batch.column("symbols")
    flat, ends = col.flatten().to_numpy(), col.offsets.to_numpy()
    return np.split(flat, ends[1:-1] - ends[0])


def scored(data: DataFrame, counts: DataFrame, lex: Lexicon, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text."""
    spark = data.sparkSession
    bottom = lex.total + SMOOTH * (lex.distinct + 1)
    base = np.log10((lex.counts + SMOOTH) / bottom)
    base[len(lex.head):-1] = 0  # tail words come from the join
    known = (lex.counts > 0).astype(float)
    known[len(lex.head):-1] = 0
    shared = spark.sparkContext.broadcast((model, base, known))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, base, known = shared.value
        for batch in batches:
            lists = lists_of(batch)
            logs = np.zeros(len(lists))
            for part, grid in in_step(lists):
                logs[part] = forward(model, grid)
            yield pa.RecordBatch.from_arrays([
                batch.column("row"), batch.column("doc_id"), batch.column("held_out"), pa.array([len(x) for x in lists], pa.int64()),
                pa.array([known[x].sum() for x in lists], pa.float64()), pa.array([base[x].sum() for x in lists], pa.float64()), pa.array(logs),
            ], ["row", "doc_id", "held_out", "n_tokens", "head_known", "head_base", "head_score"])

    heads = data.select("row", "doc_id", "held_out", "symbols").mapInArrow(
        score, "row long, doc_id long, held_out boolean, n_tokens long, head_known double, head_base double, head_score double")
    tails = data.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.n")
    last = F.conv(F.hex(F.expr("substr(word, -1, 1)")), 16, 10).cast("int")
    prior = F.when(F.length("word") > 1, F.conv(F.hex(F.expr("substr(word, length(word) - 1, 1)")), 16, 10).cast("int")).otherwise(0)
    bottoms = F.array(*[F.lit(float(n + SMOOTH * (v + 1))) for n, v in zip(lex.class_total, lex.class_distinct)])
    c = F.coalesce("c", F.lit(0))
    met = tails.join(counts, "word", "left").select(
        "row", F.when(c > 0, F.col("n")).otherwise(0).alias("known"),
        (F.col("n") * F.log10((c + SMOOTH) / F.lit(float(bottom)))).alias("base"),
        (F.col("n") * F.log10((c + SMOOTH) / F.element_at(bottoms, (last * 31 + prior) % TAILS + 1))).alias("share"))
    sums = met.groupBy("row").agg(F.sum("known").alias("known"), F.sum("base").alias("base"), F.sum("share").alias("share"))
    zero = F.lit(0.0)
    return heads.join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("head_known") + F.coalesce("known", zero)).cast("long").alias("n_known"),
        F.lit(lex.total).cast("long").alias("train_tokens"), (F.col("head_base") + F.coalesce("base", zero)).alias("base_score"),
        (F.col("head_score") + F.coalesce("share", zero)).alias("score"))


def digest(docs: DataFrame) -> DataFrame:
    rows = docs_of(docs, (fold(F.col("doc_id"), 10) == 0).alias("held_out"))
    train = rows.where(~F.col("held_out")).select("text")
    counts = written(word_counts(train), "words")
    lex = lexicon(counts, train.count())
    data = encoded(rows, lex)
    share = (lex.counts + SMOOTH) / (lex.counts + SMOOTH).sum()
    model = started(data, lex, share)
    for _ in range(ITERATIONS):
        model = baum_welch(data, model, share)
    return scored(data, counts, lex, model)
