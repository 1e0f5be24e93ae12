"""Benchmark passages in documents by latent semantic retrieval and subsequence checks.

Documents are cut into segments of SEGMENT words; a passage is a window of consecutive segments, as
many as cover a benchmark item wherever it begins. One pass over all documents counts the passages'
document frequencies and, for the randomised SVD, projects the term-frequency rows of all segments
with a sparse random sign matrix onto SKETCH rows; both are summed in Spark. Weighted by inverse
document frequency, the sketch's right singular vectors span the latent space of the TF-IDF matrix
(terms are hashed into TERMS). A second pass sums the latent vectors of every passage's words and
takes the cosine with every item. A passage is longer than its item, which dilutes the cosine, so
pairs under COSINE are candidates too wherever the words allow a leak: a common subsequence of the
least length that counts needs so many of the item's words, all but the commonest of which are
counted in every passage (``word_candidates``). This loses no leak; the cosine adds none. For
candidates the longest common subsequence of words is bounded by the words in common, then computed.
A passage leaks an item if LEAK of the item's words come in order, or PARAPHRASE of them and ANSWER
of its answer (the column ``answer``, else the item's last sentence if it has several, of three words
or more).

Items are compared in blocks of ITEM_BLOCK; all blocks are collected to the driver and broadcast
together, so the benchmark must fit there. Words are white-space separated, lower case, without marks at their ends. Null and empty texts leak nothing; items without
words are left out, equal items are compared each. Rows with equal ids are judged alone, whole texts
whatever their length. ``found`` leaves other columns out and ``kept`` returns all of them, of whatever
name. Without documents there are no rows, without items nothing is leaked.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import docs_of, partition_id, slices, texts_of

SEGMENT = 16
TERMS = 1 << 13
SKETCH, RANK = 192, 96
POWER = 3  # of the inverse document frequency in a term's weight: common words fade
FAINT = 0.03  # of the largest weight: terms below it, in more than about 2 % of passages, add nothing
COSINE = 0.36
LEAK, PARAPHRASE, ANSWER = 0.7, 0.5, 0.8
ITEM_BLOCK = 2000
TELLING_WORDS = 4  # of an item's rarer words that a candidate has at least: more or fewer change the time only
ITEM_COLUMNS = 256  # items whose words are counted at once
FOUND = "doc_id long, contaminated boolean, item_id long, share double, n_items int"
MARKS = ".,;:!?()[]{}\"'«»“”"


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts (the low bits are the term), and each text's bounds in them."""
    split = pc.utf8_split_whitespace(pa.array([t.lower() for t in texts], pa.large_string()))
    words = split.flatten().dictionary_encode()
    spelled, number = words.dictionary, words.indices.to_numpy()
    bare = pc.utf8_trim(spelled, MARKS)
    hashed = string_hashes(pc.if_else(pc.equal(bare, ""), spelled, bare))
    real = (pc.binary_length(spelled).to_numpy() > 0)[number]  # white space at a text's end splits off nothing
    ends = np.append(0, np.cumsum(real))[split.offsets.to_numpy() - split.offsets[0].as_py()]
    return hashed[number[real]], ends


def string_hashes(strings: pa.LargeStringArray) -> np.ndarray:
    """64-bit hashes: a polynomial in the bytes, mixed."""
    if not len(strings):
        return np.zeros(0, np.uint64)
    _, offsets, data = strings.buffers()
    at = np.frombuffer(offsets, np.int64)[strings.offset:strings.offset + len(strings) + 1]
    codes = np.frombuffer(data or b"", np.uint8)[at[0]:at[-1]].astype(np.uint64) + np.uint64(1)
    sizes = np.diff(at)
    powers = np.full(int(sizes.max()) + 1, 0x9E3779B97F4A7C15, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    place = np.arange(len(codes)) - np.repeat(at[:-1] - at[0], sizes)
    sums = np.zeros(len(strings), np.uint64)
    full = sizes > 0
    if full.any():
        sums[full] = np.add.reduceat(codes * powers[place], (at[:-1] - at[0])[full])
    sums = (sums ^ (sums >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return sums ^ (sums >> np.uint64(29))


def segments_of(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all segments (with the final end) and each text's bounds in them."""
    counts = -(-np.diff(ends) // SEGMENT)
    bounds = np.cumsum([0, *counts])
    owner = np.repeat(np.arange(len(counts)), counts)
    starts = ends[owner] + (np.arange(len(owner)) - bounds[owner]) * SEGMENT
    return np.append(starts, ends[-1]), bounds


@dataclass
class Space:
    idf: np.ndarray  # of each term
    basis: np.ndarray  # terms x RANK: weight of the term times its latent vector


def latent_space(docs: DataFrame) -> Space:
    """IDF and the latent basis of all passages (segments) of all documents."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([5, partition_id()])
        df, sketch, total = np.zeros(TERMS), np.zeros(SKETCH * TERMS, np.float32), 0
        for batch in slices(batches):
            hashes, ends = word_hashes(texts_of(batch))
            if not len(hashes):
                continue
            starts, _ = segments_of(ends)
            n = len(starts) - 1
            segment = np.repeat(np.arange(n), np.diff(starts))
            term = (hashes % np.uint64(TERMS)).astype(np.int64)
            cells = np.sort((segment * TERMS + term).astype(np.int32 if n * TERMS < 2**31 else np.int64))
            df += np.bincount(cells[np.flatnonzero(np.diff(cells, prepend=-1))] % TERMS, minlength=TERMS)
            row = rng.integers(0, SKETCH, n)
            sign = rng.integers(0, 2, n) * 2.0 - 1
            sketch += np.bincount(row[segment] * TERMS + term, sign[segment], SKETCH * TERMS).astype(np.float32)
            total += n
        if total:
            rows = [*sketch.reshape(SKETCH, TERMS), df.astype(np.float32)]
            for a in range(0, SKETCH + 1, 32):
                part = rows[a:a + 32]
                ids = range(a, a + len(part))
                yield pa.RecordBatch.from_pydict({"part": pa.array(ids, pa.int32()), "salt": pa.array([partition_id() % 32] * len(part), pa.int32()), "sums": pa.array([x.astype(np.float64).astype(np.float32).tobytes() for x in part], pa.binary()), "n": pa.array([total] * len(part), pa.int64())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part, n = np.zeros(TERMS), None, 0
        for batch in batches:
            for p, b, k in zip(*(batch.column(c).to_pylist() for c in ("part", "sums", "n"))):
                x = np.frombuffer(b, np.float32 if len(b) == 4 * TERMS else np.float64)
                part, total, n = p, total + x, n + k
        if part is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "salt": pa.array([0], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary()), "n": pa.array([n], pa.int64())})

    made = docs_of(docs).mapInArrow(project, "part int, salt int, sums binary, n long")
    summed = made.groupBy("part", "salt").applyInArrow(add, made.schema).groupBy("part").applyInArrow(add, made.schema)
    rows = {r["part"]: r for r in summed.collect()}  # SKETCH + 1 rows of TERMS numbers
    if not rows:
        return Space(np.ones(TERMS), np.zeros((TERMS, RANK), np.float32))
    idf = np.log((1 + rows[0]["n"]) / (1 + np.frombuffer(rows[SKETCH]["sums"])))
    seen = np.frombuffer(rows[SKETCH]["sums"]) > 0
    weight = np.where(seen, idf, 0) ** POWER
    _, size, vt = np.linalg.svd(np.stack([np.frombuffer(rows[k]["sums"]) for k in range(SKETCH)]) * weight, full_matrices=False)
    axes = np.flatnonzero(size[:RANK] > 1e-6 * max(size[0], 1e-30))  # fewer where the corpus has fewer
    use = np.zeros((RANK, TERMS))
    use[axes] = vt[axes] / size[axes, None]  # latent axes of equal spread
    basis = use.T * weight[:, None]
    basis = (basis / max(float(np.abs(basis).max()), 1e-30)).astype(np.float32)
    basis[weight < FAINT * weight.max()] = 0
    return Space(idf, basis)


@dataclass
class Items:
    ids: list[int | None]
    words: list[np.ndarray]
    answers: list[np.ndarray]
    least: np.ndarray  # words in order without which nothing leaks
    vocabulary: np.ndarray  # sorted words of all items
    distinct: list[tuple[np.ndarray, np.ndarray]]  # places in the vocabulary of an item's words, and how often it has them
    widths: np.ndarray  # segments of a passage that covers the item
    latent: np.ndarray  # normalised


def items_of(rows: list[dict], space: Space) -> Items:
    ids, own, answers = [], [], []
    for r in rows:
        hashes, _ = word_hashes([r["text"] or ""])
        if not len(hashes):
            continue
        answer = r.get("answer")
        if answer is None:
            parts = [p for p in re.split(r"(?<=[.!?])\s+", (r["text"] or "").strip()) if p]
            answer = parts[-1] if len(parts) > 1 else ""
        found, _ = word_hashes([answer])
        ids.append(r["item_id"])
        own.append(hashes)
        answers.append(found if len(found) >= 3 else found[:0])
    latent = np.array([space.basis[(w % np.uint64(TERMS)).astype(np.int64)].sum(axis=0) for w in own]).reshape(len(own), RANK)
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    vocabulary = np.unique(np.concatenate(own)) if own else np.zeros(0, np.uint64)
    distinct = []
    for w in own:
        words, times = np.unique(w, return_counts=True)
        distinct.append((np.searchsorted(vocabulary, words), times))
    least = [np.flatnonzero(np.arange(len(w) + 1) / len(w) >= (PARAPHRASE if len(a) else LEAK))[0] for w, a in zip(own, answers)]
    widths = np.array([-(-(len(w) - 1) // SEGMENT) + 1 for w in own], np.int64)
    return Items(ids, own, answers, np.array(least, np.int64), vocabulary, distinct, widths, latent.astype(np.float32))


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, row by row with running maxima."""
    if not len(a) or not len(b):
        return 0
    best = np.zeros(len(b) + 1, np.int64)
    for x in a:
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], (best[:-1] + 1) * (b == x)))
    return int(best[-1])


def enough_in_common(item: tuple[np.ndarray, np.ndarray], least: int, place: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether each passage shares ``least`` words with the item; no common subsequence is longer than what they share."""
    words, times = item
    out = np.zeros(len(begin), bool)
    step = max(1, 2_000_000 // max(int((end - begin).max(initial=1)), len(words)))
    for a in range(0, len(begin), step):
        size = end[a:a + step] - begin[a:a + step]
        row = np.repeat(np.arange(len(size)), size)
        found = place[np.arange(len(row)) + np.repeat(begin[a:a + step] - np.append(0, np.cumsum(size)[:-1]), size)]
        nth = np.minimum(np.searchsorted(words, found), len(words) - 1)
        same = words[nth] == found
        counts = np.bincount(row[same] * len(words) + nth[same], minlength=len(size) * len(words)).reshape(len(size), -1)
        out[a:a + step] = np.minimum(counts, times).sum(axis=1) >= least
    return out


def segment_totals(rows: np.ndarray, place: np.ndarray, use: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums over each segment of the rows of its words; only words in ``use`` have a row."""
    inside, place = np.append(0, np.cumsum(use))[starts], place[use]
    out = np.zeros((len(starts) - 1, rows.shape[1]), rows.dtype)
    for a in range(0, len(out), 4000):
        b = min(a + 4000, len(out))
        full = a + np.flatnonzero(inside[a + 1:b + 1] > inside[a:b])
        if len(full):
            out[full] = np.add.reduceat(rows[place[inside[a]:inside[b]]], inside[full] - inside[a], axis=0, dtype=rows.dtype)
    return out


def passage_totals(segment: np.ndarray, last: np.ndarray, width: int, total: np.ndarray, done: int = 1) -> None:
    """Makes ``total``, the sums of passages of ``done`` segments, those of ``width`` segments, as far as the text has them."""
    at = np.arange(len(segment))
    for w in range(done, width):
        more = np.flatnonzero(at + w < last)
        if len(more):
            total[more] += segment[more + w]


def latent_candidates(term: np.ndarray, starts: np.ndarray, last: np.ndarray, items: Items, space: Space) -> Iterator[np.ndarray]:
    """Passages (by first segment) and items of a latent cosine of COSINE at least, as passage * items + item."""
    segment = segment_totals(space.basis, term, space.basis.any(axis=1)[term], starts)
    total, done = segment.copy(), 1
    for width in np.unique(items.widths).tolist():
        passage_totals(segment, last, width, total, done)
        which, done = np.flatnonzero(items.widths == width), width
        least = COSINE * np.maximum(np.sqrt(np.einsum("ij,ij->i", total, total)), 1e-12)
        for a in range(0, len(total), 20_000):
            i, j = np.nonzero(total[a:a + 20_000] @ items.latent[which].T >= least[a:a + 20_000, None])
            yield (a + i) * len(items.ids) + which[j]


def word_candidates(place: np.ndarray, starts: np.ndarray, last: np.ndarray, items: Items) -> Iterator[np.ndarray]:
    """Passages and items, as above, that may have ``least`` words in common: no leaking pair is left out.

    An item's words that are commonest in these texts count as present, as long as TELLING_WORDS are
    then still wanting; of its other words a passage must hold what is wanting.
    """
    often = np.bincount(place, minlength=len(items.vocabulary) + 1)
    by_width = np.argsort(items.widths, kind="stable")
    for first in range(0, len(by_width), ITEM_COLUMNS):
        group = by_width[first:first + ITEM_COLUMNS]
        counted, wanting = np.zeros((len(items.vocabulary) + 1, len(group)), np.uint8), items.least[group]
        for j, k in enumerate(group):
            words, times = items.distinct[k]
            order = np.argsort(-often[words], kind="stable")
            granted = np.cumsum(times[order])
            n = int(np.searchsorted(granted, wanting[j] - TELLING_WORDS, "right"))
            wanting[j] -= granted[n - 1] if n else 0
            counted[words[order[n:]], j] = 1
        segment = segment_totals(counted, place, counted.any(axis=1)[place], starts)  # SEGMENT at most
        widths = items.widths[group]
        for width in np.unique(widths).tolist():
            a, b = np.searchsorted(widths, [width, width + 1])
            part = segment[:, a:b]
            total = part.astype(np.min_scalar_type(width * SEGMENT))
            passage_totals(part, last, width, total)
            i, j = np.nonzero(total >= wanting[a:b].astype(total.dtype))  # an item wants no more words than it has
            yield i * len(items.ids) + group[a + j]


def leaks(texts: list[str], items: Items, space: Space) -> list[dict[int, float]]:
    """For each text its leaked items with the share of the item's words that come in order."""
    hashes, ends = word_hashes(texts)
    out: list[dict[int, float]] = [{} for _ in texts]
    if not len(hashes) or not items.ids:
        return out
    starts, bounds = segments_of(ends)
    term = (hashes % np.uint64(TERMS)).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    last = bounds[1:][owner]
    place = np.minimum(np.searchsorted(items.vocabulary, hashes), len(items.vocabulary) - 1)
    place[items.vocabulary[place] != hashes] = len(items.vocabulary)  # no item's word
    pairs = [*latent_candidates(term, starts, last, items, space), *word_candidates(place, starts, last, items)]
    at, of = np.divmod(np.unique(np.concatenate(pairs)), len(items.ids))
    order = np.argsort(of, kind="stable")
    cuts = np.flatnonzero(np.diff(of[order], prepend=-1, append=-1))
    for a, b in zip(cuts[:-1], cuts[1:]):
        k, near = int(of[order[a]]), at[order[a:b]]
        begin, end = starts[near], starts[np.minimum(near + items.widths[k], last[near])]
        item, answer = items.words[k], items.answers[k]
        for n in np.flatnonzero(enough_in_common(items.distinct[k], items.least[k], place, begin, end)).tolist():
            text, passage = int(owner[near[n]]), hashes[begin[n]:end[n]]
            if out[text].get(k) == 1.0:
                continue
            share = common_subsequence(item, passage) / len(item)
            if share >= LEAK or share >= PARAPHRASE and len(answer) and common_subsequence(answer, passage) >= ANSWER * len(answer):
                out[text][k] = max(share, out[text].get(k, 0.0))
    return out


def blocks_of_items(benchmark: DataFrame, space: Space) -> Iterator[Items]:
    """The benchmark in blocks of bounded size, in order of its ids."""
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"), answer.alias("answer"))
    n = max(1, -(-2 * rows.count() // ITEM_BLOCK))
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        yield items_of([r.asDict() for r in part], space)


def found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, item_id (best match), share and n_items of every document."""
    space = latent_space(docs)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((space, list(blocks_of_items(benchmark, space))))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, blocks = shared.value
        for batch in slices(batches):
            texts = texts_of(batch)
            best = [(0.0, None)] * len(texts)
            n = [0] * len(texts)
            for items in blocks:
                for i, hits in enumerate(leaks(texts, items, space)):
                    n[i] += len(hits)
                    for k, share in sorted(hits.items()):
                        if share > best[i][0]:
                            best[i] = (share, items.ids[k])
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "contaminated": [x > 0 for x in n],
                "item_id": pa.array([b[1] for b in best], pa.int64()), "share": pa.array([b[0] for b in best], pa.float64()), "n_items": pa.array(n, pa.int32()),
            })

    return docs_of(docs).mapInArrow(search, FOUND)


def kept(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, without a leaked item."""
    space = latent_space(docs)
    shared = docs.sparkSession.sparkContext.broadcast((space, list(blocks_of_items(benchmark, space))))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, blocks = shared.value
        for batch in slices(batches):
            texts = texts_of(batch)
            hit = np.zeros(len(texts), bool)
            for items in blocks:
                hit |= np.array([len(h) > 0 for h in leaks(texts, items, space)])
            yield batch.filter(pa.array(~hit))

    return docs.mapInArrow(keep, docs.schema)
