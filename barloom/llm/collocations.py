"""Phrase collocations from a weighted de Bruijn graph of each language's words.

Texts are lower-cased (A-Z), split at ``[.,;:!?\\n\\v\\f\\r]`` into pieces and those at blanks and tabs
into words. Phrases of ``longest`` words are the edges of a graph: an edge leads from the node of its
first ``longest - 1`` words to that of its last, and weighs as often as the phrase occurs. Only edges
are counted in the texts, with the ends of the pieces as corrections: a shorter phrase occurs as often
as all phrases of one more word that begin with it, and once more for each piece that ends with it.
So a node's count is what flows out of it plus the pieces that end there, and so on down to words.

Each task sums the edges of its texts by itself; they then meet by (language, node), and a scan of the
sorted rows sums edges and nodes and adds the nodes up by their prefix. Nodes that hold a thousandth
of the edges of a sample of about ``SAMPLE`` documents are dealt over 64 parts by their last word; the
sample decides about the dealing alone. Edges and nodes below ``least`` occurrences stop there:
every part of a candidate occurs at least as often as the candidate.

Unary paths are then compacted: where all occurrences of a node come by one edge and leave by one
edge, the edges are joined, by pointer doubling, into one path of equal weight. A node inside a path
always lies in an edge of its own count and so never survives as a phrase. Such a path has no cycle
(a walk would have to enter it) and is no longer than a piece.

Null texts count as empty, null languages as ``und``. Repeated documents count as often as they occur.
Empty texts and tables give no rows; texts are taken whole. Ties of scores go to the higher count, then
to the phrase's bytes. Other columns, of whatever name, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from barloom.llm.common import slices, written

SAMPLE = 2000  # documents in which heavy nodes are sought
HEAVY = 1000  # a node is heavy from one of so many edges on: at most so many nodes
SALTS = 64
SCAN_ROWS = 200_000
PIECE_ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
FOLDED = bytes.maketrans(UPPER + PIECE_ENDS + BLANKS, LOWER + b"\n" * len(PIECE_ENDS) + b" " * len(BLANKS))
EDGES = "lang string, node string, last string, n long, heavy boolean"
SUMS = "lang string, size int, phrase string, n long"


def texts_by_language(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast(StringType()), F.lit("")).alias("text")
    return docs.select(F.coalesce(F.col("lang").cast(StringType()), F.lit("und")).alias("lang"), text)


def word_codes(texts: list[str]) -> tuple[np.ndarray, pa.Array]:
    """Codes of all words, -1 between pieces, and the words themselves."""
    flat = "\n".join(texts).encode("utf-8", "surrogatepass").translate(FOLDED).replace(b"\n", b" \n ")
    coded = pa.array([w for w in flat.split(b" ") if w], pa.binary()).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    brk = pc.index(coded.dictionary, pa.scalar(b"\n", pa.binary())).as_py()
    return np.where(codes == brk, -1, codes), coded.dictionary


def spelled(words: pa.Array, codes: np.ndarray) -> pa.Array:
    """The phrases of the rows of word codes."""
    columns = [words.take(pa.array(codes[:, k])).cast(pa.large_binary()) for k in range(codes.shape[1])]
    joined = columns[0] if len(columns) == 1 else pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.large_binary()))
    return joined.cast(pa.binary()).cast(pa.string())


def grams(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct phrases of ``size`` words as rows of codes, and the number of each occurrence's phrase, -1 for none."""
    n = max(0, len(codes) - size + 1)
    key, top = codes[:n].copy(), int(codes.max(initial=0)) + 1
    for k in range(1, size):
        last = codes[k : n + k]
        key = np.where((key < 0) | (last < 0), -1, key * top + last)
        if k < size - 1:
            seen, key = np.unique(key, return_inverse=True)
            key = key - int(len(seen) > 0 and seen[0] == -1)
    got, first, number = np.unique(key, return_index=True, return_inverse=True)
    none = len(got) > 0 and got[0] == -1
    rows = codes[first[int(none) :, None] + np.arange(size)] if len(got) > none else np.empty((0, size), np.int64)
    return rows, number - int(none)


def edge_rows(lang: str, texts: list[str], longest: int, heavy: pa.Array | None) -> Iterator[pa.RecordBatch]:
    """The summed edges of some texts, and as rows without a last word the ends of their pieces."""
    codes, words = word_codes(texts)
    codes = np.append(codes, -1)

    def rows(phrase: pa.Array, last: pa.Array | None, n: np.ndarray) -> pa.RecordBatch:
        hot = pc.is_in(phrase, heavy) if heavy is not None and last is not None else pa.array(np.zeros(len(n), bool))
        last = last if last is not None else pa.nulls(len(n), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), phrase, last, pa.array(n), hot], ["lang", "node", "last", "n", "heavy"])

    for size in range(1, longest):
        nodes, number = grams(codes, size)
        full = np.flatnonzero(number >= 0)
        follow = codes[full + size]
        ends = np.bincount(number[full][follow < 0], minlength=len(nodes))
        some = ends > 0
        if some.any():
            yield rows(spelled(words, nodes[some]), None, ends[some])
        if size == longest - 1 and (follow >= 0).any():
            key, n = np.unique(number[full][follow >= 0] * len(words) + follow[follow >= 0], return_counts=True)
            node, last = np.divmod(key, len(words))
            distinct, at = np.unique(node, return_inverse=True)
            yield rows(spelled(words, nodes[distinct]).take(pa.array(at)), spelled(words, last[:, None]), n)


def edges(docs: DataFrame, longest: int, heavy: list[str] | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = pa.array(heavy, pa.string()) if heavy else None
        for batch in slices(gathered(batches), 12_000_000):
            langs = batch.column("lang").to_pylist()
            texts: dict[str, list[str]] = {}
            for lang, text in zip(langs, batch.column("text").to_pylist()):
                texts.setdefault(lang, []).append(text)
            for lang, some in texts.items():
                yield from edge_rows(lang, some, longest, hot)

    return docs.mapInArrow(run, EDGES)


def gathered(batches: Iterator[pa.RecordBatch], most: int = 12_000_000) -> Iterator[pa.RecordBatch]:
    """Small batches joined up to about ``most`` bytes, so that more is summed at once."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield joined(held)
            held, size = [], 0
    if held:
        yield joined(held)


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches).combine_chunks()
    return table.to_batches()[0] if table.num_rows else batches[0]


def heavy_nodes(docs: DataFrame, longest: int) -> list[str]:
    """Nodes with a thousandth of the edges of a bounded sample of documents."""
    step = max(1, docs.count() // SAMPLE)
    some = edges(docs.where(F.pmod(F.xxhash64("text", F.lit(7)), F.lit(step)) == 0).limit(2 * SAMPLE), longest, None)
    seen = some.where(F.col("last").isNotNull()).groupBy("node").agg(F.sum("n").alias("n")).withColumn("all", F.sum("n").over(Window.partitionBy()))
    return sorted(r["node"] for r in seen.where(F.col("n") * HEAVY >= F.col("all")).select("node").collect())


def scan(batches: Iterator[pa.RecordBatch], longest: int, least: int) -> Iterator[pa.RecordBatch]:
    """Sums of edges, nodes and node prefixes from rows sorted by language, node and last word."""

    def out(lang, size, phrase, n) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([lang, pa.array(np.full(len(n), size, np.int32)), phrase, pa.array(n.astype(np.int64))], ["lang", "size", "phrase", "n"])

    def runs(*columns: pa.Array) -> np.ndarray:
        new = np.zeros(len(columns[0]), bool)
        new[:1] = True
        for c in columns:
            c = pc.fill_null(c, "")  # no word is empty
            new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
        return np.flatnonzero(new)

    def summed(table: pa.Table) -> Iterator[pa.RecordBatch]:
        lang, node, last, heavy = (table.column(c).combine_chunks() for c in ("lang", "node", "last", "heavy"))
        n = table.column("n").to_numpy()
        size = pc.count_substring(node, " ").to_numpy(zero_copy_only=False) + 1
        for k in range(1, longest - 1):
            at = np.flatnonzero(size == k)
            if len(at):
                yield out(lang.take(pa.array(at)), k, node.take(pa.array(at)), n[at])
        at = pa.array(np.flatnonzero(size == longest - 1))
        if not len(at):
            return
        lang, node, last, heavy, n = lang.take(at), node.take(at), last.take(at), heavy.take(at), n[at.to_numpy()]
        begin = runs(lang, node, last)
        count, word = np.add.reduceat(n, begin), last.take(pa.array(begin))
        keep = pa.array(begin[(count >= least) & word.is_valid().to_numpy(zero_copy_only=False)])
        if len(keep):
            phrase = pc.binary_join_element_wise(node.take(keep), last.take(keep), " ")
            yield out(lang.take(keep), longest, phrase, count[np.isin(begin, keep.to_numpy())])
        begin = runs(lang, node)
        count = np.add.reduceat(n, begin)
        lang, node = lang.take(pa.array(begin)), node.take(pa.array(begin))
        hot = np.logical_or.reduceat(heavy.to_numpy(zero_copy_only=False), begin)
        hot[[0, -1]] = True  # may go on in another block
        keep = np.flatnonzero((count >= least) | hot)  # parts of a node are summed later
        if longest > 2 and len(keep):
            yield out(lang.take(pa.array(keep)), longest - 1, node.take(pa.array(keep)), count[keep])
        if longest == 2:  # nodes are words, whose total is wanted too
            yield out(lang, 1, node, count)
            return
        prefix = pc.replace_substring_regex(node, r" [^ ]*$", "")
        begin = runs(lang, prefix)
        yield out(lang.take(pa.array(begin)), longest - 2, prefix.take(pa.array(begin)), np.add.reduceat(count, begin))

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        held = part if held is None else pa.concat_tables([held, part])
        if held.num_rows >= SCAN_ROWS:
            held = held.combine_chunks()
            begin = runs(*(held.column(c).combine_chunks() for c in ("lang", "node", "last")))[-1]
            if begin:  # the last edge may go on
                yield from summed(held.slice(0, begin).combine_chunks())
                held = held.slice(begin).combine_chunks()
            else:
                total = pa.array([pc.sum(held.column("n")).as_py()], pa.int64())
                held = held.slice(0, 1).combine_chunks().set_column(held.schema.get_field_index("n"), "n", total)
    if held is not None:
        yield from summed(held.combine_chunks())


def counts(docs: DataFrame, longest: int = 3, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to ``longest`` words with ``least`` occurrences (lang, size, phrase, n), and all words' (lang, n)."""
    if longest < 2:
        raise ValueError("longest: at least 2 words")
    texts = texts_by_language(docs)
    heavy = heavy_nodes(texts, longest)
    salt = F.when(F.col("heavy"), F.pmod(F.xxhash64("last"), F.lit(SALTS)) + 1).otherwise(F.lit(0))
    met = edges(texts, longest, heavy).withColumn("salt", salt).repartition("lang", "node", "salt")
    ordered = met.sortWithinPartitions("lang", "node", "last").select("lang", "node", "last", "n", "heavy")
    sums = written(ordered.mapInArrow(lambda b: scan(b, longest, least), SUMS), "edges")
    frequent = F.col("n") >= least
    total = lambda df: df.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))
    levels = [sums.where(F.col("size") == longest)]
    if longest > 2:
        levels.append(total(sums.where(F.col("size") == longest - 1)).where(frequent))
    shorter = None
    for size in range(max(1, longest - 2), 0, -1):
        own = sums.where(F.col("size") == size)
        if shorter is not None:
            prefix = F.regexp_replace("phrase", r" [^ ]*$", "").alias("phrase")
            own = own.unionByName(shorter.select("lang", F.lit(size).alias("size"), prefix, "n"))
        shorter = total(own)
        levels.append(shorter.where(frequent))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    words = sums.where(F.col("size") == 1) if longest <= 3 else shorter
    return written(out, "phrases"), words.groupBy("lang").agg(F.sum("n").alias("n"))


def without_first(phrase: Column) -> Column:
    return F.regexp_replace(phrase, r"^[^ ]* ", "")


def without_last(phrase: Column) -> Column:
    return F.regexp_replace(phrase, r" [^ ]*$", "")


def paths(phrases: DataFrame, longest: int = 3) -> DataFrame:
    """Unary paths of two or more edges: lang, phrase (the path's words), edges, n (the weight of each)."""
    edge = phrases.where(F.col("size") == longest).select("lang", "phrase", "n")
    node = phrases.where(F.col("size") == longest - 1).select("lang", F.col("phrase").alias("node"), "n")
    comes = edge.select("lang", F.col("phrase").alias("before"), without_first(F.col("phrase")).alias("node"), "n")
    leaves = edge.select("lang", "phrase", without_last(F.col("phrase")).alias("node"), "n")
    on = ["lang", "node", "n"]
    link = written(comes.join(node, on).join(leaves, on).select("lang", "phrase", "before", "n"), "links")
    # each edge points to the one before it, then to the one as far before that one, up to the path's first
    begins = link.select("lang", F.col("before").alias("phrase")).join(link, ["lang", "phrase"], "left_anti")
    state = written(
        link.select("lang", "phrase", F.col("before").alias("head"), F.lit(1).cast("long").alias("far"))
        .unionByName(begins.select("lang", "phrase", F.col("phrase").alias("head"), F.lit(0).cast("long").alias("far"))),
        "paths",
    )
    while True:
        ahead = state.select("lang", F.col("phrase").alias("head"), F.col("head").alias("next"), F.col("far").alias("more"))
        step = written(state.join(ahead, ["lang", "head"]).select("lang", "phrase", F.col("next").alias("head"), (F.col("far") + F.col("more")).alias("far"), (F.col("more") > 0).alias("moved")), "paths")
        state = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    weight = link.select("lang", "phrase", "n")
    tail = state.where("far > 0").join(weight, ["lang", "phrase"]).select("lang", "head", "far", "n", F.regexp_extract("phrase", r"[^ ]*$", 0).alias("word"))
    whole = tail.groupBy("lang", "head").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("more"), F.sort_array(F.collect_list(F.struct("far", "word"))).alias("rest"))
    return whole.select("lang", F.concat_ws(" ", "head", F.col("rest.word")).alias("phrase"), (F.col("more") + 1).alias("edges"), "n")


def pieces_of(phrase: Column, size: Column | int) -> Column:
    """All runs of ``size`` words of a phrase."""
    words = F.split(phrase, " ")
    size = F.lit(size) if isinstance(size, int) else size
    starts = F.sequence(F.lit(1), F.size(words) - size + 1)
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, size), " "))


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, share: int = 50, top: int | None = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the ``top`` phrases of each language (None: all).

    The score is floor(1000000 a a / (l r)) at the cut with the least. A phrase goes where a longer
    candidate that holds it has ``share`` percent of its occurrences.
    """
    if not 0 <= share <= 100:
        raise ValueError("share: 0 to 100 percent")
    phrases, total = counts(docs, longest, least)
    out = phrases.where(F.col("size") >= 2)
    if longest > 2:
        inside = paths(phrases, longest)
        of_paths = inside.select("lang", F.explode(F.slice(pieces_of(F.col("phrase"), longest - 1), 2, F.col("edges").cast("int") - 1)).alias("phrase"))
        out = out.join(of_paths.distinct(), ["lang", "phrase"], "left_anti")
        parts = None
        for size in range(2, longest):
            longer = phrases.where(F.col("size") > size)
            part = longer.select("lang", F.explode(pieces_of(F.col("phrase"), size)).alias("phrase"), F.col("n").alias("above"))
            parts = part if parts is None else parts.unionByName(part)
        above = parts.groupBy("lang", "phrase").agg(F.max("above").alias("above"))
        out = out.join(above, ["lang", "phrase"], "left").where(F.col("above").isNull() | (F.col("above") * 100 < F.col("n") * share))
    words = F.split("phrase", " ")
    cut = out.select("lang", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"), words.alias("w"))
    cut = cut.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("right"))
    left = phrases.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r")}
    scored = cut.join(left, ["lang", "left"]).join(right, ["lang", "right"]).withColumns({f"d_{c}": v for c, v in wide.items()})
    scored = scored.withColumn("score", F.expr("(cast(1000000 as decimal(7,0)) * d_a * d_a) div (d_l * d_r)"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order))
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
