"""The training-data operators against brute force, with nulls, empty texts, ties and clashing columns."""

import collections
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import decontamination, hidden_markov, language, licences, near_duplicates, packing, token_counts, token_records, topk, toxicity
from barloom.llm.common import fold, prepared
from barloom.llm.components import components
from barloom.llm.tokens import encoder

WORDS = [a + b for a in ("ka", "lo", "mi", "tun", "ser", "vo", "ish") for b in ("ra", "pel", "dos", "wick", "nne", "ti")]
ODD = ["", None, "  two  blanks", "a <|endoftext|> b", "x\n\ny", "tab\tend ", "ΑΣ ﬁn Ünï", "it's 're", "\n", "日本語 text", "x" * 3000, "a\0b c"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, piece int, held_out boolean, term int"


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    out = [sentence(rng, rng.randint(1, 120)) for _ in range(150)]
    out += ODD + [out[3], out[3], out[4] + " tail"] + [sentence(rng, 4000)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ("en", "de")[i % 2], "s", 1, 0.5, 1, True, 3) for i, t in enumerate(texts)]
    return prepared(spark).createDataFrame([*rows, (None, "no id here", None, None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return prepared(spark).createDataFrame([], SCHEMA)


@pytest.mark.parametrize("vocabulary", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_cut_texts_encode_as_whole_ones(texts, vocabulary):
    coder, some = encoder(vocabulary), [t or "" for t in texts]
    assert coder.encode(some) == coder.whole(some)


def test_records_round_trip(docs, empty, texts):
    got = {r["doc_id"]: r for r in token_records.digest(docs).collect()}
    coder, at = encoder("word_bpe_49k.json"), 0
    for doc_id, text in [(None, "no id here"), *enumerate(texts)]:
        ids = coder.whole([text or ""])[0] + (1).to_bytes(4, "little")
        assert (got[doc_id]["start"], got[doc_id]["n_tokens"], got[doc_id]["ids_crc32"]) == (at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4
    assert token_records.digest(empty).count() == 0


def test_records_shuffled_reads_hold_the_same_rows_and_damage_is_seen(docs, tmp_path):
    manifest = token_records.write_records(docs, f"file://{tmp_path}/r")
    rows = lambda seed: sorted(r["ids"] for r in token_records.read_records(manifest, f"file://{tmp_path}/r", seed).collect())
    assert rows(None) == rows(7)
    whole = bytearray(token_records.frame(b"payload"))
    whole[14] ^= 1
    with pytest.raises(token_records.RecordError):
        token_records.read_frame(memoryview(bytes(whole)), 0)
    with pytest.raises(token_records.RecordError):
        token_records.read_frame(memoryview(token_records.frame(b"payload")[:-3]), 0)


def test_token_counts_of_texts_and_prefixes(docs, empty, texts):
    coder = encoder("byte_bpe_50k.json")
    n = lambda t: len(coder.whole([t])[0]) // 4
    for r in token_counts.token_counts(docs.where("doc_id is not null"), limit=40).collect():
        text = texts[r["doc_id"]] or ""
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n(text), len(text.encode()), n(text) > 40)
        assert n(text[:r["fit_chars"]]) <= 40
    for text in [t or "" for t in (*texts[:8], *ODD) if len(t or "") < 600]:
        table = token_counts.tables([text], "byte_bpe_50k.json")[0]
        assert [token_counts.tokens_of_prefix(table, c, "byte_bpe_50k.json") for c in range(len(text) + 1)] == [n(text[:c]) for c in range(len(text) + 1)]
    assert token_counts.token_counts(empty).count() == 0


def test_top_k_equals_brute_force_with_ties(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(300, 6)), 1)
    x[50:180] = x[50]  # many equal vectors
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [1.0, None]), (1020, [float("nan")] * 6), (None, [0.0] * 6), (1040, [1.0, 2.0])]
    got = collections.defaultdict(list)
    for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 5, query_block=8).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    q = np.floor(64 * x).astype(int)
    for i in range(0, 300, 20):
        s = q @ q[i]
        assert got[i] == [(j, s[j]) for j in sorted((j for j in range(300) if j != i), key=lambda j: (-s[j], j))[:5]]
    assert set(got) == set(range(0, 300, 20))
    few = topk.top_k(spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 5)
    assert few.count() == 2
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.lit(True)).count() == 0


def test_packing_holds_every_token_once(docs, empty, texts):
    rows = packing.packed(docs, size=64).collect()
    pieces, filled = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        filled[r["sequence_id"]].append(r)
    coder = encoder("byte_bpe_50k.json")
    for doc_id, text in [(None, "no id here"), *enumerate(texts)]:
        ids = coder.whole([text or ""])[0] + (2).to_bytes(4, "little")
        own = sorted(pieces[doc_id], key=lambda r: r["piece"])
        assert [r["start"] for r in own] == list(np.cumsum([0, *(r["length"] for r in own)])[:-1]) and sum(r["length"] for r in own) == len(ids) // 4
        assert all(r["ids_crc32"] == zlib.crc32(ids[4 * r["start"]:4 * (r["start"] + r["length"])]) for r in own)
        assert all(r["length"] == 64 for r in own[1:])
    for own in filled.values():
        own.sort(key=lambda r: r["offset"])
        ends = np.cumsum([r["length"] for r in own])
        assert ends[-1] <= 64 and [r["offset"] for r in own] == [0, *ends[:-1]]
    assert len(filled) <= 1.05 * sum(r["length"] for r in rows) / 64 + 1
    assert packing.packed(empty).count() == 0


def test_crossover_and_mutation_keep_every_item_once():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 90, 300)
    a, b = (packing.best_fit(rng.permutation(300).tolist(), lengths, 100) for _ in range(2))
    for bins in (packing.crossover(a, b, lengths, 100, rng), packing.mutated(a, lengths, 100, rng), packing.evolve(lengths, 100, 1, a)):
        assert sorted(i for _, items in bins for i in items) == list(range(300))
        assert all(f == sum(lengths[i] for i in items) <= 100 for f, items in bins)


def test_language_model_base_is_exact_and_states_help(docs, empty, texts):
    words = lambda t: (t or "").encode().lower().split() + [None]
    train = collections.Counter(w for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10 for w in words(t))
    n, v = sum(train.values()), len(train)
    for r in hidden_markov.digest(docs.where("doc_id is not null")).collect():
        own = words(texts[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(train[w] > 0 for w in own), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own))
    assert hidden_markov.digest(empty).count() == 0


def test_forward_recursion_equals_the_sum_over_all_paths():
    rng = np.random.default_rng(2)
    m = hidden_markov.Model(np.array([0.3, 0.7]), np.array([[0.9, 0.1], [0.4, 0.6]]), rng.dirichlet(np.ones(4), 2).T)
    texts = [np.array(x, np.int32) for x in ([0, 1, 3], [2, 2, 1, 0, 3], [3])]
    for part, grid in hidden_markov.in_step(texts):
        for i, got in zip(part, hidden_markov.forward(m, grid)):
            total = 0.0
            for path in np.ndindex(*[2] * len(texts[i])):
                p = m.initial[path[0]] * m.emission[texts[i][0], path[0]]
                for t in range(1, len(path)):
                    p *= m.transition[path[t - 1], path[t]] * m.emission[texts[i][t], path[t]]
                total += p
            assert got == pytest.approx(np.log10(total))


def test_languages_are_told_apart_on_held_out_texts(spark, empty):
    rng = random.Random(1)
    two = [sentence(rng, 12) if i % 2 else " ".join("".join(reversed(w)) for w in sentence(rng, 12).split()) for i in range(300)]
    rows = [(i, t, ("de", "en")[i % 2]) for i, t in enumerate(two)] + [(900, "123 !!", "en"), (901, None, "en"), (902, "ka", None)]
    got = {r["doc_id"]: r for r in language.digest(prepared(spark).createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    held = [got[i]["lang_pred"] == ("de", "en")[i % 2] for i in range(300) if got[i]["held_out"]]
    assert len(held) > 60 and np.mean(held) > 0.97
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and len(got) == 303
    assert language.digest(empty).count() == 0


def test_toxic_words_are_found_also_with_gaps(spark, docs, empty):
    rng = random.Random(9)
    bad = ["grubnax", "zorvil", "quodge"]
    rows, labels = [], []
    for i in range(600):
        words = sentence(rng, 40).split()
        if i % 3 == 0:
            words[5:5] = [rng.choice(bad)]
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 3 == 0)))
    rows += [(1000, "ka g.r.u.b.n.a.x ra"), (1001, "lora z o r v i l mira"), (1002, ""), (1003, None), (1004, sentence(rng, 4000))]
    table, marks = prepared(spark).createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.digest(table, marks).collect()}
    held = [i for i in range(600) if got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == int(i % 3 == 0) for i in held]) > 0.97
    assert got[1000]["predicted"] == got[1001]["predicted"] == 1
    assert got[1002]["predicted"] == got[1003]["predicted"] == got[1004]["predicted"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert toxicity.digest(docs, marks.limit(0)).agg(F.max("score")).first()[0] == 0 and toxicity.digest(empty, marks).count() == 0


def test_training_reads_all_units_of_long_texts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda toxic, clean: seen.append((toxic, clean)))
    long_text = " ".join(f"a{k:05d}" for k in range(6000))
    table = prepared(spark).createDataFrame([(1, f"zorvil {long_text}"), (2, f"{long_text} zwick")], "doc_id long, text string")
    toxicity.fit(table, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"), F.lit(True))
    (toxic,), (clean,) = seen[0]
    assert len(toxic) == len(clean) == 6001 and "zorvil" in toxic and "zwick" in clean


def test_subsequence_kernel_equals_the_naive_sum():
    def naive(a, b):
        def weights(word):
            marked, out = "<" + word + ">", {}
            for i in range(len(marked)):
                for j in range(i + 1, len(marked)):
                    for k in range(j + 1, min(len(marked), i + 8)):
                        sub = marked[i] + marked[j] + marked[k]
                        out[sub] = out.get(sub, 0.0) + toxicity.DECAY ** (k - i - 2)
            return out
        x, y = weights(a), weights(b)
        dot = lambda p, q: sum(v * q.get(s, 0.0) for s, v in p.items())
        return dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5

    words = ["grubnax", "grruubnax", "g4ubnax", "aaaaaa", "abc", "zorvil", "abcdefghijklmnopqrst"]
    got = toxicity.kernels(words, words[:4])[0]
    want = [[naive(a, b) for b in words[:4]] for a in words]
    assert np.allclose(got, want, atol=1e-5)


@pytest.mark.parametrize("quoted", [False, True])
def test_wrong_labels_and_quotes_do_not_silence_insults(quoted):
    """One toxic training text in twenty is labelled clean; or three clean texts quote every insult."""
    rng = random.Random(17)
    bad = ["grubnax", "zorvilq", "quodgex", "plimfotz"]

    def text(toxic):
        words = sentence(rng, 40).split()
        return " ".join([*words[:7], rng.choice(bad), *words[7:]] if toxic else words)

    cut = lambda t: sorted({u for s in toxicity.text_units(t) for u in s})
    toxic, clean = [cut(text(True)) for _ in range(200)], [cut(text(False)) for _ in range(800)]
    if quoted:
        clean += [cut(" ".join([text(False), *bad])) for _ in range(3)]
    else:
        toxic, clean = toxic[:190], clean + toxic[190:]
    scorer = toxicity.Scorer(toxicity.train(toxic, clean))
    assert (scorer.scores([text(True) for _ in range(200)]) >= toxicity.CUT).mean() > 0.97
    assert (scorer.scores([text(False) for _ in range(400)]) >= toxicity.CUT).mean() < 0.02


def test_training_without_a_unit_of_toxic_texts_alone():
    """All units of toxic texts come in clean ones too: the highest odds stand in, or no unit at all."""
    toxic, clean = [["zorvil", "mira"]] * 4, [["mira"]] * 6 + [["zorvil", "mira"]]
    model = toxicity.train(toxic, clean)
    assert model is not None and model.margins(["zorvil"])[0] > model.margins(["mira"])[0]
    assert toxicity.train([["mira"]], [["mira"]]) is None


def test_near_duplicates_equal_brute_force(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK", 16)  # groups take several blocks
    rng = random.Random(5)
    base = sentence(rng, 200).split()
    texts = {i: t for i, t in enumerate(ODD)}
    for i in range(20, 90):
        w = list(base)
        w[rng.randrange(200)] = f"new{i}"
        texts[i] = " ".join(w)
    texts |= {100: texts[20], 101: texts[20], 102: texts[20].upper(), 103: "short one", 104: "short one"}
    table = prepared(spark).createDataFrame(list(texts.items()), "doc_id long, text string")
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        n = min(5, len(w))
        sets[i] = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if w else set()
    near = {i: [j for j in sets if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in sets}
    got = {r["doc_id"]: r for r in near_duplicates.joined(table).collect()}
    assert {i: r["n_links"] for i, r in got.items()} == {i: len(v) for i, v in near.items()}
    assert got[20]["group_id"] == got[102]["group_id"] == 20 and got[104]["class_id"] == 103
    kept = {r["doc_id"] for r in near_duplicates.first_of_groups(table).collect()}
    assert kept & set(range(20, 103)) == {20} and {0, 1} <= kept
    assert near_duplicates.joined(empty).count() == 0
    assert near_duplicates.joined(docs).count() == docs.count()


def test_candidates_keep_pairs_of_unlucky_signatures(spark):
    a = np.arange(near_duplicates.VALUES, dtype=np.uint32)
    rows = [(0, a.tobytes())]
    for rid, agree in ((1, 30), (2, 38), (3, 20)):  # one tree's four values among them; 20 of 64 is no near copy
        b = a + np.uint32(1000 * rid)
        same = [*range(0, 64, 16), *(k for k in range(64) if k % 16)][:agree]
        b[same] = a[same]
        rows.append((rid, b.tobytes()))
    edges = near_duplicates.candidate_edges(spark.createDataFrame(rows, "rid long, sig binary"), 4).collect()
    assert {r["a"] for r in edges} | {r["b"] for r in edges} == {0, 1, 2}


def test_trie_scan_equals_brute_force_over_any_cuts(spark):
    """Labels of few values in many small ranges: every pair in a node of a tree is found, and no other label passes but at borders."""
    rng = np.random.default_rng(4)
    n = near_duplicates.VALUES
    sigs = rng.integers(0, 3, (60, n)).astype(np.uint32)
    texts = spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(sigs)], "rid long, sig binary")
    trie = near_duplicates.tries(texts)
    for depth in (2, 3, 5):
        rows = near_duplicates.matched(trie, [depth] * near_duplicates.TREES).collect()
        of_run = {}
        for r in rows:
            of_run.setdefault(r["run"], set()).add(r["rid"])
        got = {frozenset(v) for v in of_run.values() if len(v) > 1}
        want = {}
        for t in range(near_duplicates.TREES):
            for i, s in enumerate(sigs):
                want.setdefault((t, *s[t::near_duplicates.TREES][:depth]), set()).add(i)
        want = {frozenset(v) for v in want.values() if len(v) > 1}
        assert got == want
    pairs = near_duplicates.node_pairs(trie)
    for (t, d), x in pairs.items():
        nodes = np.unique(sigs[:, t::near_duplicates.TREES][:, :d], axis=0, return_counts=True)[1]
        assert x == (nodes * (nodes - 1) // 2).sum()


def test_prefixes_shorten_where_the_trie_is_empty():
    full = {(t, d): 10.0 ** (9 - d) for t in range(8) for d in range(2, near_duplicates.DEPTH + 1)}  # eight hot trees
    depths = near_duplicates.shortened(full)
    assert near_duplicates.expected_recall(depths, 0.8) >= near_duplicates.RECALL
    assert depths[:8] == [near_duplicates.DEPTH] * 8 and near_duplicates.SHALLOWEST == min(depths[8:])
    assert near_duplicates.shortened({}, threshold=0.99) == [near_duplicates.DEPTH] * near_duplicates.TREES


def test_forest_recall_against_brute_force(spark):
    """Pairs just over the threshold: whole links at the depths that the data choose."""
    rng = random.Random(8)
    texts, near = [], set()
    for k in range(150):
        words = [f"w{rng.randrange(10**6)}" for _ in range(220)]
        other = list(words)
        for at in rng.sample(range(0, 215, 10), 4):  # 4 changed words: Jaccard 0.82 to 0.84
            other[at] = f"x{rng.randrange(10**6)}"
        texts += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        a, b = ({tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (words, other))
        if len(a & b) >= 0.8 * len(a | b):
            near |= {2 * k, 2 * k + 1}
    got = near_duplicates.joined(prepared(spark).createDataFrame(texts, "doc_id long, text string"))
    linked = {r["doc_id"] for r in got.where("n_links > 0").collect()}
    assert len(near) > 250 and linked <= near and len(linked) >= 0.99 * len(near)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, x) for x in range(101, 120)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(31)) and all(got[i] == 100 for i in range(100, 120))


def test_leaks_are_found_exact_and_paraphrased(spark, docs, empty):
    rng = random.Random(8)
    other = [f"{w}{k}" for w in WORDS for k in range(20)]
    pick = lambda n: [rng.choice(other) for _ in range(n)]
    items = [pick(40) for _ in range(20)]
    rows = [(i, " ".join(pick(300))) for i in range(200)]
    for i in range(20):
        words = pick(250)
        words[33 + 7 * i:33 + 7 * i] = items[i]
        rows.append((300 + i, " ".join(words)))
        said = [w for k, w in enumerate(items[i]) if k % 8]  # one word in eight goes, others come in
        said[10:10] = pick(2)
        rows.append((400 + i, " ".join(pick(90) + said + pick(50))))
    rows += [(500, None), (501, "")]
    bench = spark.createDataFrame([*((i, " ".join(w)) for i, w in enumerate(items)), (90, None), (91, "")], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontamination.found(prepared(spark).createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert all(got[300 + i]["item_id"] == i and got[300 + i]["share"] == 1 for i in range(20))
    assert sum(got[400 + i]["contaminated"] for i in range(20)) >= 18
    assert not any(got[i]["contaminated"] for i in (*range(200), 500, 501))
    assert decontamination.found(empty, bench).count() == 0 and decontamination.found(docs, bench.limit(0)).where("contaminated").count() == 0


def test_leaks_of_short_and_long_items_equal_brute_force(spark):
    rng = random.Random(12)
    other = [f"{w}{k}" for w in WORDS for k in range(20)]
    pick = lambda n: [rng.choice(WORDS[:6] if rng.random() < 0.4 else other) for _ in range(n)]
    items, rows = [], []
    for i, n in enumerate([8, 18, 18, 24, 33, 34, 59, 120] * 2):
        said = [f"{w}." if k == n - 5 else w for k, w in enumerate(pick(n))]  # the last four words are the answer
        items.append(said)
        for part in (1.0, 0.75, 0.6, 0.45):
            words = pick(130)
            kept = [w for k, w in enumerate(said) if k >= n - 4 or rng.random() < part]
            at = rng.randint(0, 120)
            words[at:at] = [x for w in kept for x in ([w] if rng.random() < 0.8 else [w, *pick(1)])]
            rows.append((len(rows), " ".join(words)))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {r["doc_id"]: (r["n_items"], r["share"]) for r in decontamination.found(prepared(spark).createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    hashed = [decontamination.word_hashes([" ".join(w)])[0] for w in items]
    for doc_id, text in rows:
        words, shares = decontamination.word_hashes([text])[0], []
        for item in hashed:
            width = decontamination.SEGMENT * (-(-(len(item) - 1) // decontamination.SEGMENT) + 1)
            passages = [words[a:a + width] for a in range(0, len(words), decontamination.SEGMENT)]
            n = [decontamination.common_subsequence(item, p) / len(item) for p in passages]
            shares.append(max((x for x, p in zip(n, passages) if x >= 0.7 or x >= 0.5 and decontamination.common_subsequence(item[-4:], p) == 4), default=0))
        assert got[doc_id] == (sum(x > 0 for x in shares), max(shares))


def test_common_subsequence_equals_the_plain_table():
    rng = np.random.default_rng(1)
    for _ in range(30):
        a, b = rng.integers(0, 6, rng.integers(1, 20)), rng.integers(0, 6, rng.integers(1, 30))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert decontamination.common_subsequence(a, b) == t[-1, -1]


def test_licences_are_inherited_from_the_nearest_directory(spark, docs, empty):
    mit, gpl = licences.TEMPLATES[8][1], licences.TEMPLATES[6][1]
    rows = [
        (1, "repo/LICENSE", mit), (2, "repo/src/a.py", "import x"), (3, "repo/vendor/COPYING", "\n".join(gpl.split(", "))),
        (4, "repo/vendor/deep/b.c", "int x;"), (5, "repo/vendor/c.c", "// Licensed under the Apache License, Version 2.0.\nint y;"),
        (6, "other/d.py", None), (7, None, ""), (8, "repo/src/e.py", "we licensed the version under the sea to two people"),
    ]
    got = {r["doc_id"]: (r["licence"], r["licence_dir"]) for r in licences.licences(prepared(spark).createDataFrame(rows, "doc_id long, path string, text string"), F.col("path")).collect()}
    assert got == {1: ("MIT", None), 2: ("MIT", "repo"), 3: ("GPL-3.0", None), 4: ("GPL-3.0", "repo/vendor"), 5: ("Apache-2.0", None), 6: (None, None), 7: (None, None), 8: ("MIT", "repo")}
    assert licences.licences(empty, F.lit("x")).count() == 0 and licences.licences(docs, F.col("source")).count() == docs.count()


def test_pipeline_stages_keep_columns_and_clean_rows(spark, docs, tmp_path):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    rng = random.Random(2)
    rows = [(i, sentence(rng, 80), "en", "s", 1) for i in range(40)]
    table = prepared(spark).createDataFrame([*rows, (50, rows[0][1], "en", "s", 1), (51, "12 34", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, rows[7][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = table
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == columns
    assert {r["doc_id"] for r in kept.collect()} == set(range(40)) - {7}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(range(40)) - {7}


def test_fold_of_null_ids(spark):
    assert spark.range(1).select(fold(F.lit(None).cast("long"), 3)).first()[0] == 0


def test_word_hashes_split_as_text_does():
    texts = ["", "  Ab c. ", "a\nb\té  c", "...", " ", "x" * 5000 + " (ab)", "ab, c"]
    hashes, ends = decontamination.word_hashes(texts)
    words = [[w.strip(decontamination.MARKS) or w for w in t.lower().split()] for t in texts]
    assert np.diff(ends).tolist() == [len(w) for w in words]
    pairs = set(zip([w for ws in words for w in ws], hashes.tolist()))
    assert len(pairs) == len({w for w, _ in pairs}) == len({h for _, h in pairs})
    assert decontamination.word_hashes([])[1].tolist() == [0]
