"""Packing of token sequences by a grouping genetic algorithm on islands.

Documents become pieces of at most ``size`` tokens (only longer ones are cut, the first piece takes
the remainder). Full pieces fill a sequence alone. The others are dealt at random into groups of
bounded size; each group is packed by several islands, one task each. An individual is a set of
bins; crossover injects whole well-filled bins of one parent into the other, removes the bins that
then hold a piece twice, and best-fits the displaced pieces. After each epoch the best individual of
every island moves to all islands of its group. At the end the badly filled bins of all groups are
opened and their pieces packed again in fewer, larger rounds, until one group holds what is left.

Every piece is packed once, whatever the islands find. Null texts are empty texts (one end id).
Equal ids and repeated rows are different documents, texts of any length are read whole and other
columns, whatever their names, are left out. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import docs_of, partition_id, slices, texts_of, written
from barloom.llm.tokens import encoder

SIZE = 1024
GROUP = 4096  # pieces of a group at most, about
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 2, 2, 6, 6
WELL_FILLED = 0.98  # of a sequence: bins that crossover injects and that stay closed at the end
PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, size: int = SIZE, vocabulary: str = "byte_bpe_50k.json", end_id: int = 2) -> DataFrame:
    """Pieces of every document with an id of their own (``uid``), written once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, uid = encoder(vocabulary), partition_id() << 40
        for batch in slices(batches):
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), coder.encode(texts_of(batch))):
                ids += end_id.to_bytes(4, "little")
                n = len(ids) // 4
                edges = [0, *range((n - 1) % size + 1, n + 1, size)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    rows.append((uid, doc_id, k, a, b - a, zlib.crc32(ids[4 * a:4 * b])))
                    uid += 1
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["uid", "doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return written(docs_of(docs).mapInArrow(cut, PIECES), "pieces")


def best_fit(items, lengths: np.ndarray | list[int], size: int, into: list = ()) -> list[tuple[int, list[int]]]:
    """Best fit of ``items`` in the given order into ``into`` and new bins; open bins by free room, so that the tightest fit is found at once."""
    lengths = lengths.tolist() if isinstance(lengths, np.ndarray) else lengths
    filled, held = [f for f, _ in into], [list(i) for _, i in into]
    by_room, rooms = [[] for _ in range(size + 1)], 0
    for k, f in enumerate(filled):
        by_room[size - f].append(k)
        rooms |= 1 << size - f
    for item in items:
        length = lengths[item]
        above = rooms >> length
        if above:
            room = length + (above & -above).bit_length() - 1
            ready = by_room[room]
            k = ready.pop()
            if not ready:
                rooms ^= 1 << room
            filled[k] += length
            held[k].append(item)
            room -= length
        else:
            k, room = len(filled), size - length
            filled.append(length)
            held.append([item])
        by_room[room].append(k)
        rooms |= 1 << room
    return list(zip(filled, held))


def fitness(bins: list, size: int) -> tuple[int, float]:
    """Fewer bins, then unevenly filled ones: a nearly empty bin is close to being saved."""
    return -len(bins), sum((f / size) ** 2 for f, _ in bins)


def crossover(a: list, b: list, lengths: np.ndarray | list[int], size: int, rng: np.random.Generator) -> list:
    """Whole well-filled bins of ``b`` into ``a``; displaced pieces by best fit, longest first."""
    good = [x for x in b if x[0] >= WELL_FILLED * size]
    if not good:
        good = sorted(b, key=lambda x: -x[0])[:max(1, len(b) // 4)]
    take = rng.random(len(good)) < 0.5
    injected = [x for x, t in zip(good, take) if t]
    taken = {i for _, items in injected for i in items}
    kept, displaced = [], []
    for filled, items in a:
        if taken.isdisjoint(items):
            kept.append((filled, items))
        else:
            displaced += [i for i in items if i not in taken]
    return best_fit(sorted(displaced, key=lambda i: -lengths[i]), lengths, size, injected + kept)


def mutated(bins: list, lengths: np.ndarray | list[int], size: int, rng: np.random.Generator) -> list:
    """Open the emptiest bins and a few others and fit their pieces again."""
    order = sorted(range(len(bins)), key=lambda k: bins[k][0])
    opened = set(order[:2]) | set(rng.integers(0, len(bins), 2).tolist())
    loose = [i for k in opened for i in bins[k][1]]
    rest = [x for k, x in enumerate(bins) if k not in opened]
    return best_fit(sorted(loose, key=lambda i: -lengths[i]), lengths, size, rest)


def evolve(lengths: np.ndarray, size: int, seed, elite: list | None = None) -> list:
    """One island's epoch; ends early where the bins are as few as their total length allows."""
    rng, least = np.random.default_rng(seed), -(-int(lengths.sum()) // size)
    population, sizes = [elite] if elite else [], lengths.tolist()
    spread = np.linspace(0, 0.2, POPULATION)
    while len(population) < POPULATION:
        noise = 1 + spread[len(population)] * rng.standard_normal(len(lengths))
        population.append(best_fit(np.argsort(-lengths * noise, kind="stable").tolist(), sizes, size))
        if len(population[-1]) == least:
            return population[-1]
    rank = lambda x: fitness(x, size)
    for _ in range(GENERATIONS):
        population.sort(key=rank, reverse=True)
        if len(population[0]) == least:
            break
        half = POPULATION // 2
        for k in range(half, POPULATION):
            a, b = rng.integers(0, half, 2)
            child = crossover(population[a], population[b], sizes, size, rng)
            population[k] = mutated(child, sizes, size, rng)
    return max(population, key=rank)


def packed_groups(pieces: DataFrame, groups: int, salt: int, size: int) -> DataFrame:
    """uid, length, bin (the smallest uid in it), filled: each group by its best island."""
    dealt = pieces.select("uid", "length", F.pmod(F.xxhash64("uid", F.lit(salt)), F.lit(groups)).alias("part_no"))
    state = dealt.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1)))).withColumn("bin", F.lit(None).cast("long"))
    schema = "part_no long, island int, uid long, length long, bin long, n_bins long, square double"

    def epoch(key, table):
        part_no, island = key[0].as_py(), key[1].as_py()
        t = table.sort_by("uid")
        uid, lengths = t.column("uid").to_numpy(), t.column("length").to_numpy()
        elite, old = None, t.column("bin")
        if old.null_count == 0:
            _, where = np.unique(old.to_numpy(), return_inverse=True)
            order = np.argsort(where, kind="stable")
            sets = np.split(order, np.flatnonzero(np.diff(where[order])) + 1)
            elite = [(int(lengths[s].sum()), s.tolist()) for s in sets]
        best = evolve(lengths, size, [salt, part_no, island, int(elite is not None)], elite)
        bins = np.empty(len(uid), np.int64)
        for _, items in best:
            bins[items] = uid[items].min()
        few, square = fitness(best, size)
        return pa.table({
            "part_no": pa.array(np.full(len(uid), part_no)), "island": pa.array(np.full(len(uid), island, np.int32)),
            "uid": uid, "length": lengths, "bin": bins,
            "n_bins": pa.array(np.full(len(uid), -few, np.int64)), "square": np.full(len(uid), square),
        })

    best = None
    for turn in range(EPOCHS):
        # Seconds of work in few bytes: dealt out to tasks by number, not by size.
        tasks = min(groups * ISLANDS, int(state.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        dealt_out = state.repartition(tasks, "part_no", "island").groupBy("part_no", "island")
        found = written(dealt_out.applyInArrow(epoch, schema), "islands")
        rank = F.struct((-F.col("n_bins")).alias("n"), F.col("square"), (-F.col("island")).alias("i"))
        winner = found.groupBy("part_no").agg((-F.max(rank)["i"]).cast("int").alias("island"))
        best = found.join(winner, ["part_no", "island"]).select("part_no", "uid", "length", "bin")
        if turn + 1 < EPOCHS:  # the elite moves to every island of its group
            state = best.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))
    filled = best.groupBy("bin").agg(F.sum("length").alias("filled"))
    return best.select("uid", "length", "bin").join(filled, "bin")


def pack(pieces: DataFrame, size: int = SIZE, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to pieces."""
    full = pieces.where(F.col("length") == size).select("uid", F.col("uid").alias("sequence_id"))
    left = pieces.where(F.col("length") < size).select("uid", "length")
    n, done, salt = left.count(), full, 0
    while n:
        groups = -(-n // group)
        found = written(packed_groups(left, groups, salt, size), "packed")
        if groups == 1:
            closed, n = found, 0
        else:
            closed = found.where(F.col("filled") >= WELL_FILLED * size)
            left = found.where(F.col("filled") < WELL_FILLED * size).select("uid", "length")
            was, n, salt = n, left.count(), salt + 1
            if n > was // 2:  # pieces that hardly fill together: their sequences stay as they are
                closed, n = found, 0
        done = done.unionByName(closed.select("uid", F.col("bin").alias("sequence_id")))
    # A sequence holds at most ``size`` pieces of a token or more: these windows are small.
    placed = pieces.join(done, "uid")
    before = F.sum("length").over(_inside())
    return placed.withColumn("offset", F.coalesce(before, F.lit(0))).drop("uid")


def _inside():
    from pyspark.sql import Window

    return Window.partitionBy("sequence_id").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)


def packed(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    return pack(cut_pieces(docs, size), size)
