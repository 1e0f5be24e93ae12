"""Jaccard join of word 5-grams: MinHash prefix forest, then exact verification.

Equal texts form one class; only one of each goes on. Every text has ``TREES`` labels of ``DEPTH``
MinHash values of their own. A tree is the sorted list of its labels over all texts, dealt to tasks by
ranges, so that a trie node of depth k is a run of labels with the same first k values; a scan of the
neighbours gives each label the deepest node that it shares. Matching starts at whole labels. Then
prefixes are shortened, one level of one tree at a time, always where the trie has the fewest new
pairs for what the step adds to the recall, until a pair at the threshold shares a node in some tree
with probability ``RECALL`` at least. So the depths follow the data: trees whose upper nodes are full
(boilerplate, one hot prefix) stay deep and the others make up for them. Texts in one node are
candidates; a pair is dropped where its signatures agree far less than the
threshold allows (under 0.45 of 64 values: 2 in 10 billion pairs of similarity 0.8). Connected
candidates are a group, and all pairs inside a group are verified on whole shingle sets, in blocks:
a group of n texts sends each text n / BLOCK times, and only counts and a spanning forest come back.

Words are white-space separated, in lower case; a text of fewer than five words has one shingle,
all of them. Texts without words link to nothing. Rows with one id and different texts are different
documents; repeated rows are copies. Null texts are empty, texts of any length are read whole. Other
columns, whatever their names, are left out. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import WordHashes, docs_of, slices, texts_of, written
from barloom.llm.components import components

WORDS, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 16, 6, 0.9997
SHALLOWEST = 2  # prefixes are not shortened beyond this many values
VALUES = TREES * DEPTH  # MinHash values; tree t has values t, t + TREES, ...
COMPARED, LEAST_AGREEMENT = 64, 0.45  # of these values so many agree in a candidate pair
BLOCK = 2048  # texts of a block; runs beyond it are linked without a look at signatures
BUNDLE_ROWS = 20_000
LABEL = 4 * (DEPTH + 1)  # bytes of a label
BROADCAST_ROWS = 1_000_000  # class hashes that may be broadcast: 16 bytes each


def expected_recall(depths: Sequence[int], threshold: float) -> float:
    """Probability that a pair of this similarity shares a node of some tree."""
    return 1 - float(np.prod([1 - threshold**d for d in depths]))


def shortened(pairs: dict[tuple[int, int], float], threshold: float = THRESHOLD, target: float = RECALL) -> list[int]:
    """The matched prefix of each tree; ``pairs`` counts the pairs in nodes of (tree, depth)."""
    depths = [DEPTH] * TREES

    def price(t: int) -> tuple[float, int, int]:
        d = depths[t]
        gain = np.log(1 - threshold**d) - np.log(1 - threshold ** (d - 1))
        return (pairs.get((t, d - 1), 0.0) - pairs.get((t, d), 0.0) + 1) / gain, -d, t

    while expected_recall(depths, threshold) < target and max(depths) > SHALLOWEST:
        depths[min((t for t in range(TREES) if depths[t] > SHALLOWEST), key=price)] -= 1
    return depths


def permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240501)
    return rng.integers(1, 1 << 63, VALUES, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, VALUES, dtype=np.uint64)


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """64-bit hashes of all runs of WORDS words (one of all words where there are fewer)."""
    n = min(WORDS, len(words))
    if n == 0:
        return words
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = (out ^ words[k:len(words) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(shingles), 4096):
        part = shingles[at:at + 4096]
        mixed = part[None, :] * a[:, None]
        mixed += b[:, None]
        out = np.minimum(out, (mixed >> np.uint64(32)).min(axis=1).astype(np.uint32))
    return out


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, cls (hash of the whole text), signature (null without words)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, (a, b) = WordHashes(), permutations()
        for batch in slices(batches):
            words, ends = hashes.of_texts(texts_of(batch))
            sigs = [signature(shingle_hashes(words[x:y]), a, b).tobytes() if y > x else None for x, y in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("cls"), pa.array(sigs, pa.binary())], ["doc_id", "cls", "sig"])

    rows = docs_of(docs).select("doc_id", "text", class_of("text"))
    return written(rows.mapInArrow(sign, "doc_id long, cls binary, sig binary"), "signatures")


def class_of(text: str):
    return F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))).alias("cls")


def labels(texts: DataFrame) -> DataFrame:
    """rid, label: for each tree its number and its MinHash values, big-endian, so that bytes sort as values do."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, DEPTH, TREES)
            out = np.empty((len(sigs), TREES, DEPTH + 1), ">u4")
            out[:, :, 0] = np.arange(TREES)
            out[:, :, 1:] = sigs.transpose(0, 2, 1)
            body = pa.FixedSizeBinaryArray.from_buffers(pa.binary(LABEL), len(sigs) * TREES, [None, pa.py_buffer(out.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("rid").to_numpy(), TREES)), body.cast(pa.binary())], ["rid", "label"])

    return texts.select("rid", "sig").mapInArrow(cut, "rid long, label binary")


def tries(texts: DataFrame) -> DataFrame:
    """rid, label, deep: the labels that share SHALLOWEST values or more with a neighbour in the sorted trees.

    ``deep`` is the longest prefix shared. The first and the last label of a task's range may share one
    with another task's and pass as wholly shared; the sizes of nodes decide about them.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid, rows, left = np.zeros(0, np.int64), np.zeros((0, DEPTH + 1), ">u4"), np.zeros(0, np.int64)

        def kept(upto: int, right: np.ndarray) -> pa.RecordBatch:
            deep = np.maximum(left[:upto], right)
            at = np.flatnonzero(deep >= SHALLOWEST)
            return pa.RecordBatch.from_pydict({
                "rid": pa.array(rid[at], pa.int64()), "label": pa.array([r.tobytes() for r in rows[at].astype(">u4")], pa.binary()),
                "deep": pa.array(deep[at], pa.int32())})

        for batch in batches:
            if batch.num_rows == 0:
                continue
            new = np.frombuffer(b"".join(batch.column("label").to_pylist()), ">u4").reshape(-1, DEPTH + 1)
            first = not len(rid)
            rid, rows = np.append(rid, batch.column("rid").to_numpy()), np.concatenate([rows, new])
            shared = np.cumprod(rows[1:] == rows[:-1], axis=1).sum(axis=1) - 1  # the tree's number does not count
            left = np.concatenate([[DEPTH] if first else left, shared])
            yield kept(len(rid) - 1, shared)
            rid, rows, left = rid[-1:], rows[-1:], left[-1:]
        if len(rid):
            yield kept(1, np.array([DEPTH]))

    ordered = labels(texts).repartitionByRange("label", "rid").sortWithinPartitions("label", "rid")
    return written(ordered.mapInArrow(scan, "rid long, label binary, deep int"), "tries")


def node_pairs(trie: DataFrame) -> dict[tuple[int, int], float]:
    """Pairs in the nodes of each (tree, depth): TREES * DEPTH numbers."""
    level = F.explode(F.sequence(F.lit(SHALLOWEST), "deep")).alias("depth")
    nodes = trie.select("label", level).groupBy("depth", F.expr("substring(label, 1, 4 + 4 * depth)").alias("node")).agg(F.count("*").cast("double").alias("n"))
    tree = F.conv(F.hex(F.substring("node", 1, 4)), 16, 10).cast("int").alias("tree")
    sums = nodes.groupBy(tree, "depth").agg(F.sum(F.expr("n * (n - 1) / 2")).alias("pairs"))
    return {(r["tree"], r["depth"]): r["pairs"] for r in sums.collect()}


def matched(trie: DataFrame, depths: Sequence[int]) -> DataFrame:
    """rid, run: the hash of the node in which each label lies at its tree's depth."""
    taken = F.array(*map(F.lit, depths))[F.conv(F.hex(F.substring("label", 1, 4)), 16, 10).cast("int")]
    rows = trie.withColumn("depth", taken).where("deep >= depth")
    return rows.select("rid", F.expr("xxhash64(substring(label, 1, 4 + 4 * depth))").alias("run"))


def bundled(rows: DataFrame, keys: list[str], per_bundle: int) -> DataFrame:
    """Small groups share a call: whole groups are dealt to bundles of bounded expected size."""
    n = max(1, -(-rows.count() // per_bundle))
    return rows.withColumn("bundle", F.pmod(F.xxhash64(*keys), F.lit(n))).groupBy("bundle")


def spans(keys: np.ndarray) -> Iterator[np.ndarray]:
    """Row numbers of each run of equal keys."""
    order = np.argsort(keys, kind="stable")
    yield from np.split(order, np.flatnonzero(np.diff(keys[order])) + 1)


def roots(linked: np.ndarray) -> np.ndarray:
    """Smallest position reachable from each, in a symmetric boolean matrix with a true diagonal."""
    label = np.arange(len(linked))
    while True:
        new = np.array([label[row].min() for row in linked])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def candidate_edges(texts: DataFrame, depth: int | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """A spanning forest of the texts that share a node and whose signatures agree enough.

    The matched prefixes are shortened to the target recall, or all of the given ``depth``.
    """
    trie = tries(texts)
    runs = matched(trie, [depth] * TREES if depth else shortened(node_pairs(trie), threshold))
    sizes = runs.groupBy("run").agg(F.count("*").alias("n"), F.min("rid").alias("head")).where("n > 1")
    together = written(runs.join(sizes, "run"), "runs")
    stars = together.where(F.col("n") > BLOCK).select(F.col("rid").alias("a"), F.col("head").alias("b"))
    small = together.where(F.col("n") <= BLOCK).select("run", "rid").join(texts.select("rid", F.substring("sig", 1, 4 * COMPARED).alias("sig")), "rid")

    def compare(table):
        run, rid = table.column("run").to_numpy(), table.column("rid").to_numpy()
        sigs = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(-1, COMPARED)
        least, a, b = int(np.ceil(LEAST_AGREEMENT * COMPARED)), [], []
        order = np.argsort(run, kind="stable")
        cuts = np.flatnonzero(np.diff(run[order])) + 1
        begins, ends = np.append(0, cuts), np.append(cuts, len(order))
        pairs = np.flatnonzero(ends - begins == 2)
        x, y = order[begins[pairs]], order[begins[pairs] + 1]
        near = (sigs[x] == sigs[y]).sum(axis=1) >= least
        a.append(rid[x[near]])
        b.append(rid[y[near]])
        for k in np.flatnonzero(ends - begins > 2):
            at = order[begins[k]:ends[k]]
            at = at[np.argsort(rid[at])]
            agree = np.zeros((len(at), len(at)), np.uint8)
            for v in range(COMPARED):
                agree += sigs[at, v][:, None] == sigs[at, v][None, :]
            root = roots(agree >= least)
            a.append(rid[at])
            b.append(rid[at[root]])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    rows = written(small, "members")
    found = bundled(rows, ["run"], BUNDLE_ROWS).applyInArrow(compare, "a long, b long").where("a <> b")
    return stars.where("a <> b").unionByName(found)


def in_blocks(members: DataFrame) -> DataFrame:
    """Rows (root, low, high, block, rid): every pair of blocks of a group, with its texts."""
    sizes = members.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    placed = members.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    paired = placed.select("root", "rid", "block", other)
    return paired.select("root", "rid", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))


def shared_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the left sets with the right ones."""
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    often = np.bincount(codes) > 1
    column = np.cumsum(often) - 1
    use = often[codes]
    codes, owner = column[codes[use]], owner[use]
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(codes, kind="stable")
    codes, owner = codes[order], owner[order]
    width = 2048
    for a in range(0, int(codes[-1]) + 1 if len(codes) else 0, width):
        s = slice(*np.searchsorted(codes, [a, a + width]))
        x = np.zeros((len(sets), width), np.float32)
        x[owner[s], codes[s] - a] = 1
        out += x[left] @ x[right].T
    return out


def verified(groups: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """rid, root (of the block), links: documents linked to a text, counted once for each pair."""
    rows = written(in_blocks(groups).join(sets, "rid"), "blocks")

    def verify(table):
        key = [table.column(c).to_numpy() for c in ("root", "low", "high")]
        rid, copies = table.column("rid").to_numpy(), table.column("copies").to_numpy()
        block, grams = table.column("block").to_numpy(), table.column("grams")
        whole = np.unique(np.stack(key), axis=1, return_inverse=True)[1].ravel()
        out_rid, out_root, out_links = [], [], []
        for at in spans(whole):
            at = at[np.unique(rid[at], return_index=True)[1]]  # by rid; a text comes once
            if len(at) < 2:
                continue
            sets = [np.frombuffer(grams[int(i)].as_py(), np.uint64) for i in at]
            n = np.array([len(s) for s in sets], np.float64)
            low, high = key[1][at[0]], key[2][at[0]]
            left = np.flatnonzero(block[at] == low)
            right = np.flatnonzero(block[at] == high)
            if not len(left) or not len(right):
                continue
            common = shared_counts(sets, left, right).astype(np.float64)
            linked = common * (1 + threshold) >= threshold * (n[left][:, None] + n[right][None, :]) - 1e-9
            full = np.eye(len(at), dtype=bool)
            full[np.ix_(left, right)] |= linked
            full |= full.T
            links = full @ copies[at] - copies[at]
            out_rid.append(rid[at])
            out_root.append(rid[at[roots(full)]])
            out_links.append(links)
        empty = [np.zeros(0, np.int64)]
        return pa.table({k: np.concatenate(v or empty).astype(np.int64) for k, v in (("rid", out_rid), ("root", out_root), ("links", out_links))})

    return written(bundled(rows, ["root", "low", "high"], BUNDLE_ROWS // 10).applyInArrow(verify, "rid long, root long, links long"), "verified")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """rid, copies, grams (sorted distinct 64-bit shingle hashes) of the wanted texts."""
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    rows = docs_of(docs).select("doc_id", "text", class_of("text"))
    same = F.col("w.cls").eqNullSafe(F.col("d.cls")) & F.col("w.rep_id").eqNullSafe(F.col("d.doc_id"))
    texts = rows.alias("d").join(wanted.alias("w"), same).select("rid", "copies", "text")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches):
            words, ends = hashes.of_texts(texts_of(batch))
            grams = [np.unique(shingle_hashes(words[x:y])).tobytes() for x, y in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("copies"), pa.array(grams, pa.binary())], ["rid", "copies", "grams"])

    return written(texts.mapInArrow(build, "rid long, copies long, grams binary"), "shingles")


def joined(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (smallest id of its equal texts), group_id (smallest id of its connected
    near copies) and n_links (other documents of similarity ``threshold`` or more)."""
    marked = signed(docs)
    classes = marked.groupBy("cls").agg(F.min("doc_id").alias("rep_id"), F.count("*").alias("copies"), F.first("sig").alias("sig"))
    classes = written(classes.withColumn("rid", F.monotonically_increasing_id()), "classes")
    texts = classes.where("sig IS NOT NULL")
    near = components(candidate_edges(texts, threshold=threshold))
    members = written(near.select(F.col("node").alias("rid"), "root").join(classes.select("rid", "cls", "rep_id", "copies"), "rid"), "groups")
    sets = shingle_sets(docs, members.select("rid", "cls", "rep_id", "copies"))
    found = verified(members.select("rid", "root"), sets, threshold)
    groups = components(found.select(F.col("rid").alias("a"), F.col("root").alias("b")))
    ids = groups.join(classes.select(F.col("rid").alias("node"), "rep_id"), "node")
    first = ids.groupBy("root").agg(F.min("rep_id").alias("group_id"))
    of_group = ids.join(first, "root").select(F.col("node").alias("rid"), "group_id")
    counted = found.groupBy("rid").agg(F.sum("links").alias("links"))
    known = classes.join(of_group, "rid", "left").join(counted, "rid", "left")
    worded = F.col("sig").isNotNull()
    known = known.select(
        "cls", worded.alias("worded"), F.col("rep_id").alias("class_id"), F.coalesce("group_id", "rep_id").alias("group_id"),
        F.when(worded, F.col("copies") - 1 + F.coalesce("links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"))
    each = marked.select("doc_id", "cls").join(known, "cls")
    own = F.when(F.col("worded"), F.col("group_id")).otherwise(F.col("doc_id")).alias("group_id")
    return each.select("doc_id", "class_id", own, "n_links")


def first_of_groups(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of every group of near copies, the one with the smallest id; all columns of ``docs``."""
    found = joined(docs, threshold)
    keep = found.where(F.col("doc_id").eqNullSafe(F.col("group_id"))).select(F.col("doc_id").alias("kept_id")).distinct()
    text_key = max(docs.columns, key=len) + "_key"  # a name that no column has
    once = docs.withColumn(text_key, F.md5(F.coalesce(F.col("text"), F.lit("")))).dropDuplicates(["doc_id", text_key])
    keep = keep.withColumnRenamed("kept_id", text_key + "_id")
    return once.join(keep, F.col("doc_id").eqNullSafe(F.col(text_key + "_id")), "left_semi").drop(text_key)
