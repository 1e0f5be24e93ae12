"""Hard negatives, collocations and byte-level BPE against brute force and libraries."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import byte_bpe, collocations, hard_negatives
from barloom.llm.common import prepared

DOCS = "doc_id long, text string, lang string"


# --- byte-level BPE ---

ODD = "aab the  \n\t\r\x0b\x0c\x1c\x1d\x85\xa0 　'sll've!?.,<|endoftext|>\0éüß中文字ы9٣12½Ⅷ😀́​"


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    own = byte_bpe.codec("byte_bpe_50k.tiktoken")
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def ids_of(text):
    return np.frombuffer(byte_bpe.codec("byte_bpe_50k.tiktoken").encode([text])[0], "<i4").tolist()


def test_bpe_equals_library_on_odd_texts(library):
    rng = random.Random(5)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randrange(80))) for _ in range(3000)]
    texts += ["", " ", "a" * 3000, " " * 2000, "\n" * 300 + "x", "ab" * 2000, "x" * 64, "x" * 65, "ы" * 700, " a", "a ", "a \n b"]
    for text in texts:
        assert ids_of(text) == library.encode_ordinary(text), repr(text)


def test_bpe_trees_equal_naive_merges():
    own = byte_bpe.codec("byte_bpe_50k.tiktoken")

    def naive(word):
        parts = [bytes([b]) for b in word]
        while True:
            ranks = [(own.ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in own.ranks]
            if not ranks:
                return [own.ranks[p] for p in parts]
            _, k = min(ranks)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    rng = random.Random(6)
    words = [bytes(rng.choice(b"aaabethrion \xc3\xa9\x00\xff") for _ in range(rng.randrange(2, 33))) for _ in range(800)]
    many = own.merge_many(words, 32)
    for word, ids in zip(words, many):
        assert np.frombuffer(ids, "<i4").tolist() == naive(word)
        assert np.frombuffer(own.merge_one(word), "<i4").tolist() == naive(word)


def test_bpe_digest(spark, library):
    texts = ["The cat's  hat\n\n", None, "", "aé" * 5000, "same", "same"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r for r in byte_bpe.digest(docs.withColumn("decoded", F.lit(1))).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert byte_bpe.digest(docs.where("false")).count() == 0


def test_bpe_decode_null_and_slices(spark):
    rows = spark.createDataFrame([(1, [40, 1101]), (2, None), (3, [])], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["decoded"] for r in byte_bpe.decode(rows).collect()}
    table = byte_bpe.codec("byte_bpe_50k.tiktoken").table.to_pylist()
    assert got[2] is None and bytes(got[3]) == b"" and bytes(got[1]) == table[40] + table[1101]


# --- collocations ---


def brute_counts(rows, longest):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(fold)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    out[lang or "und", " ".join(words[i : i + size])] += 1
    return out


def brute(rows, longest, least, top):
    f = brute_counts(rows, longest)
    often = {k: n for k, n in f.items() if n >= least and " " in k[1]}
    total = Counter()
    for (lang, phrase), n in f.items():
        total[lang] += n if " " not in phrase else 0
    above = Counter()
    for (lang, phrase), n in often.items():
        words = phrase.split(" ")
        for size in range(2, len(words)):
            for i in range(len(words) - size + 1):
                key = (lang, " ".join(words[i : i + size]))
                above[key] = max(above[key], n)
    found = []
    for (lang, phrase), a in often.items():
        if above[lang, phrase] * 100 >= 50 * a:
            continue
        words = phrase.split(" ")
        cuts = []
        for k in range(1, len(words)):
            left, right = f[lang, " ".join(words[:k])], f[lang, " ".join(words[k:])]
            cuts.append((1000000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        found.append((lang, phrase, a, left, right, total[lang], score))
    out = []
    for lang in total:
        own = sorted((r for r in found if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        out += [(r[0], i + 1, *r[1:]) for i, r in enumerate(own[:top])]
    return sorted(out)


def mixed_texts():
    rng = random.Random(3)
    words = ["the", "Of", "a", "new", "york", "city", "été", "中文", "x"]
    passage = " ".join(f"w{i}" for i in range(40))
    rows = [(" ".join(rng.choice(words) + rng.choice(["", "", "", ",", ".", "\n", "\t", "  "]) for _ in range(rng.randrange(0, 60))), rng.choice(["en", "de", None])) for _ in range(150)]
    rows += [(f"so {passage} ends.", "en")] * 12 + [(passage, "de")] * 11 + [(None, "en"), ("", None), (" .,; ", "fr"), ("lone", "fr")]
    return rows


@pytest.mark.parametrize("longest", [2, 3, 4, 5])
def test_collocations_equal_brute_force(spark, longest):
    rows = mixed_texts()
    docs = spark.createDataFrame([(i, t, g, 1) for i, (t, g) in enumerate(rows)], DOCS + ", phrase int").repartition(5)
    got = collocations.collocations(docs, longest=longest, least=10, top=200).collect()
    assert sorted(map(tuple, got)) == brute(rows, longest, 10, 200)


def test_collocations_counts_in_small_blocks(spark, monkeypatch):
    rows = mixed_texts()
    docs = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(rows)], DOCS).repartition(3)
    f = {k: n for k, n in brute_counts(rows, 3).items() if n >= 10}
    monkeypatch.setattr(collocations, "HEAVY", 20)  # many heavy nodes
    got, _ = collocations.counts(docs)
    assert {(r["lang"], r["phrase"]): r["n"] for r in got.collect()} == f


def test_scan_cuts_blocks_anywhere(monkeypatch):
    import pyarrow as pa

    rng = random.Random(4)
    rows = sorted(("en", f"{rng.choice('ab')} {rng.choice('cd')}", rng.choice("wxyz"), rng.randrange(1, 4), False) for _ in range(400))
    monkeypatch.setattr(collocations, "SCAN_ROWS", 7)
    columns = list(zip(*rows))
    table = pa.RecordBatch.from_pydict(dict(zip(["lang", "node", "last", "n", "heavy"], map(list, columns))))
    out = Counter()
    for batch in collocations.scan((table.slice(i, 3) for i in range(0, 400, 3)), 3, 1):
        for r in batch.to_pylist():
            out[r["size"], r["phrase"]] += r["n"]
    want = Counter()
    for _, node, last, n, _ in rows:
        want[3, f"{node} {last}"] += n
        want[2, node] += n
        want[1, node[0]] += n
    assert out == want


def test_paths_are_compacted(spark):
    rows = mixed_texts()
    docs = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(rows)], DOCS)
    phrases, _ = collocations.counts(docs)
    long = {(r["lang"], r["edges"], r["n"]): r["phrase"] for r in collocations.paths(phrases).collect()}
    passage = " ".join(f"w{i}" for i in range(40))
    assert long["en", 40, 12] == f"so {passage} ends"
    assert long["de", 38, 11] == passage


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, None), (2, " \t.", "en")], DOCS)).count() == 0


# --- hard negatives ---


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score int")


def brute_negatives(rows, positives=5, negatives=10):
    use = []
    for vec_id, x, label, _ in rows:
        if None in (vec_id, x, label) or not x or any(v is None or not np.isfinite(v) for v in x):
            continue
        use.append((vec_id, [int(np.floor(256 * float(np.float32(v)))) for v in x], label))
    out = []
    for a, q, label in use:
        if a % 10:
            continue
        scored = [(-sum(p * v for p, v in zip(q, x)), c, other) for c, x, other in use if c != a]
        best = sorted((s, c) for s, c, other in scored if other == label)[:positives]
        for s, p in best:
            fit = sorted((t, c) for t, c, other in scored if other != label and 30 * -s <= 100 * -t <= 90 * -s)
            out += [(a, p, i + 1, c, -s, -t) for i, (t, c) in enumerate(fit[:negatives])]
    return sorted(out)


def clustered(n, d, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d))
    rows = []
    for i in range(n):
        g = int(rng.integers(6))
        x = (centres[g] + 0.4 * rng.normal(size=d)).astype(np.float32).tolist()
        rows.append((i, x, g if rng.random() < 0.8 else int(rng.integers(6)), 0))
    return rows


@pytest.mark.parametrize("seed, d", [(1, 8), (2, 7), (3, 1)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, seed, d):
    monkeypatch.setattr(hard_negatives, "TASK_ROWS", 100)
    monkeypatch.setattr(hard_negatives, "ROWS_A_CELL", 4)
    rows = clustered(500, d, seed)
    rows += [(1000 + i, *rows[40][1:]) for i in range(60)]  # copies of one vector tie
    rows += [(2000, None, 1, 0), (2010, [0.1] * d, None, 0), (2020, [None] * d, 1, 0), (2030, [float("nan")] * d, 1, 0), (2040, [float("inf")] * d, 1, 0), (None, [0.1] * d, 1, 0)]
    got = hard_negatives.hard_negatives(vectors(spark, rows).repartition(4), F.col("vec_id") % 10 == 0, anchor_block=40)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows)


def test_walk_follows_the_bounds():
    rng = np.random.default_rng(0)
    u, v = rng.normal(size=9), rng.normal(size=7)
    here = np.array([0, 2, 3, 8]), np.arange(7)
    walked = list(hard_negatives.walk((u, v), here, -0.5))
    bounds = [b for _, _, b in walked]
    assert bounds == sorted(bounds, reverse=True)
    assert {(i, j) for i, j, _ in walked} == {(i, j) for i in here[0] for j in here[1] if u[i] + v[j] >= -0.5}


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x = rng.integers(-300, 300, size=(400, 9))
    index = hard_negatives.Index((hard_negatives.codebook(x[:, :4], 5, 1), hard_negatives.codebook(x[:, 4:], 5, 2)))
    (i, r1), (j, r2) = index.cells(x)
    for near, r, radius in ((i, r1, index.radii[0]), (j, r2, index.radii[1])):
        np.maximum.at(radius, near, r)
    for q in x[:40]:
        (u, lu), (v, lv) = index.bounds(q)
        s = x @ q
        assert (s <= u[i] + v[j]).all() and (s >= lu[i] + lv[j]).all()


def test_hard_negatives_on_small_tables(spark):
    anchor = F.col("vec_id") % 10 == 0
    assert hard_negatives.hard_negatives(vectors(spark, []), anchor).count() == 0
    assert hard_negatives.hard_negatives(vectors(spark, [(0, [1.0], 1, 0)]), anchor).count() == 0
    rows = [(0, [1.0, 0.0], 1, 0), (1, [1.0, 0.0], 1, 0), (2, [0.5, 0.0], 2, 0), (3, [1e30, 0.0], 2, 0), (4, [0.5], 2, 0)]
    got = hard_negatives.hard_negatives(vectors(spark, rows), anchor).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 2, 65536, 32768)]
    same = [(0, [1.0], 1, 0), (0, [1.0], 1, 0), (5, [0.5], 2, 0)]  # rows of one id are not partners
    assert hard_negatives.hard_negatives(vectors(spark, same), anchor).count() == 0


# --- rules of the earlier operators ---


def test_marks_without_a_letter_have_no_language():
    from barloom.llm.language import words_of

    words, ends = words_of(["́̂ 12", "éte", ""])
    assert words == ["éte"] and ends.tolist() == [0, 0, 1, 1]


def test_top_k_leaves_huge_components_out(spark):
    from barloom.llm import topk

    rows = [(0, [1.0, 2.0]), (1, [1e300, 0.0]), (2, [3.0, -1.0]), (3, [2.0**40, 0.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("x", F.lit(1)), F.col("vec_id") == 0)
    assert [tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()] == [(0, 1, 2, 64 * 64)]


def test_first_of_groups_keeps_columns_of_any_name(spark):
    from barloom.llm.near_duplicates import first_of_groups

    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, text, "a", 1, 1), (2, text, "b", 2, 2), (3, "other words", "c", 3, 3)], "doc_id long, text string, kept_class string, kept_id int, group_id int")
    got = first_of_groups(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.kept_class) for r in got.collect()) == [(1, "a"), (3, "c")]


def test_start_sample_and_head_do_not_depend_on_partitions(spark):
    from barloom.llm import hidden_markov

    counts = spark.createDataFrame([(bytearray(f"w{i:05d}".encode()), 1 + i % 700) for i in range(3000)], "word binary, c long")
    heads = []
    for parts in (1, 7):
        hidden_markov_head, hidden_markov.HEAD = hidden_markov.HEAD, 100
        try:
            heads.append(hidden_markov.lexicon(counts.repartition(parts), 10))
        finally:
            hidden_markov.HEAD = hidden_markov_head
    a, b = (vars(h) for h in heads)
    assert str(a) == str(b)


def test_language_of_repeated_and_long_rows_with_clashing_columns(spark):
    """Columns named like the operators' own ones do not matter; equal rows get equal answers."""
    from barloom.llm import language

    words = {"aa": "gula mora pelu", "bb": "xyth quorr zhenk"}
    rows = [(i, " ".join([words["ab"[i % 2] * 2]] * (1 + i % 3)), "ab"[i % 2] * 2, 1.0, True, "z") for i in range(60)]
    rows += [(100, words["aa"] * 20_000, None, 0.0, False, "z")] * 2 + [(101, words["aa"] + " " + words["bb"], None, None, None, None)]
    table = prepared(spark).createDataFrame(rows, "doc_id long, text string, lang string, score double, held_out boolean, lang_pred string")
    got = language.digest(table).collect()
    assert len(got) == len(rows) and all(r.lang_pred == "ab"[r.doc_id % 2] * 2 for r in got if r.doc_id < 60)
    assert [r.lang_pred for r in got if r.doc_id == 100] == ["aa", "aa"]


def test_packing_and_leaks_ignore_clashing_columns(spark):
    from barloom.llm import decontamination, packing

    item = "the quick orange heron walked over seven frozen lakes before the first light of the coldest morning"
    rows = [(1, f"start {item} end", 5, "x"), (1, f"start {item} end", 5, "x"), (2, None, None, None), (3, "nothing of that kind", 1, "y")]
    table = prepared(spark).createDataFrame(rows, "doc_id long, text string, length long, sequence_id string")
    packed = packing.packed(table)
    assert packed.count() == 4 and packed.agg(F.countDistinct("sequence_id")).first()[0] == 1
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert sorted(r.doc_id for r in decontamination.kept(table, bench).collect()) == [2, 3]
    assert decontamination.kept(table, bench).columns == table.columns
