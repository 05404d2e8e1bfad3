"""Links and mean similarities of texts without all pairs, against brute force."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.functions.text import word_count
from spanloom.operators import similarity
from spanloom.plans import repairs


def shingles(text, n):
    w = text.lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset()


def near(x, y):
    return len(x & y) / len(x | y)


@pytest.fixture(scope="module")
def texts():
    """300 edited copies of one text, some groups of few, exact copies, loners, and texts without words."""
    r = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    out = []
    for base, n in ((0, 120), (1, 5), (2, 3), (3, 2)):
        own = random.Random(base).sample(words, 60)
        for _ in range(n):
            w = list(own)
            for _ in range(r.randint(0, 2)):
                w[r.randrange(len(w))] = r.choice(words)
            out.append(" ".join(w[: 60 - r.randint(0, 6)]))
    out += [out[0]] * 4 + [out[121]] + [" ".join(r.choice(words) for _ in range(r.randint(1, 40))) for _ in range(60)] + ["", "  ", None]
    return [(f"k{i:04}", t) for i, t in enumerate(out)]


@pytest.mark.parametrize(("threshold", "block"), [(0.6, 1024), (0.8, 16)])
def test_links(spark, texts, monkeypatch, threshold, block):
    monkeypatch.setattr(similarity, "BLOCK", block)
    frame = spark.createDataFrame(texts, "key string, text string").repartition(4)
    sets = {k: shingles(t or "", 3) for k, t in texts}
    sets = {k: s for k, s in sets.items() if s}
    links, root, rep = dict.fromkeys(sets, 0), {k: k for k in sets}, {}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, s in sets.items():
        rep.setdefault(s, k)
    for a, b in combinations(sets, 2):
        if near(sets[a], sets[b]) >= threshold:
            links[a], links[b] = links[a] + 1, links[b] + 1
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {tuple(r) for r in similarity.linked_texts(frame, 3, threshold).collect()}
    assert got == {(k, rep[s], find(k), links[k]) for k, s in sets.items()} and max(links.values()) > 30
    parts = {tuple(r) for r in similarity.text_components(frame, 3, threshold).collect()}
    firsts = set(rep.values())
    linked = {k for k in firsts if any(j != k and find(j) == find(k) for j in firsts)}
    assert parts == {(k, find(k)) for k in linked}


def test_mean_similarities(spark, texts):
    frame = spark.createDataFrame(texts, "key string, text string")
    members = similarity.clusters(frame, 3, 0.6).select("key", "rep")
    sets = similarity.shingle_sets(frame, 3)
    own = {}
    for k, r in members.collect():
        own.setdefault(r, []).append(shingles(dict(texts)[k], 3))
    want = {r: (len(v), sum(near(x, y) for x, y in combinations(v, 2)) * 2 / len(v) / (len(v) - 1)) for r, v in own.items()}
    got = {x.rep: x for x in similarity.pairwise_summary(members, sets, every=sets).collect()}
    assert all(got[r].size == n and got[r].mean_similarity == pytest.approx(m) and got[r].error == 0 for r, (n, m) in want.items())
    alone = [x for x in got.values() if x.rep not in want]
    assert len(alone) == sets.count() - sum(n for n, _ in want.values()) and all(x.size == 1 and x.mean_similarity == 1 for x in alone)
    about = {x.rep: x for x in similarity.pairwise_summary(members, sets, exact_up_to=10).collect()}
    large = [r for r, (n, _) in want.items() if n > 10]
    assert large and about.keys() == want.keys() and all(0 < about[r].error < 0.05 and abs(about[r].mean_similarity - want[r][1]) < 4 * about[r].error for r in large)


def test_shared_items_go_by_number(spark, texts, monkeypatch):
    """One table is written, no other lies between the shuffles; items are of 32 bits, and similarities from them those of the whole sets."""
    tables = []
    monkeypatch.setattr(similarity, "written", lambda df, own=similarity.written: tables.append(own(df)) or tables[-1])
    frame = spark.createDataFrame(texts, "key string, text string").repartition(4)
    shared, members = similarity.named_sets(similarity.packed_shingle_sets(frame, 3), numbers=True)
    assert len(tables) == 1 and shared.schema["items"].dataType.simpleString() == "array<int>"
    sets = {k: shingles(t or "", 3) for k, t in texts}
    names = {r.key: r.uid for r in members.where("key = rep").collect()}
    held = {r.uid: (r.m, r["items"], r.df) for r in shared.collect()}
    assert set(names) == {min(k for k in sets if sets[k] == s) for s in sets.values() if s}
    df = {}
    for k in names:
        for i in sets[k]:
            df[i] = df.get(i, 0) + 1
    for k, uid in names.items():
        m, items, counts = held.get(uid, (len(sets[k]), [], []))
        assert m == len(sets[k]) and len(set(items)) == len(items) and counts == sorted(df[i] for i in sets[k] if df[i] > 1)
    for a, b in combinations(names, 2):
        both = set(held.get(names[a], (0, []))[1]) & set(held.get(names[b], (0, []))[1])
        assert len(both) == len(sets[a] & sets[b])


def test_sets_that_reach_no_other_are_left_out(spark, monkeypatch):
    """Rows with one run of words in common and no more are neither sent as items nor written, nor are rows outside of clusters."""
    rows = [(f"k{i:03}", f"one common head {i}a {i}b {i}c {i}d {i}e {i}f") for i in range(300)]
    rows += [("l0", rows[7][1]), ("l1", rows[7][1] + " g"), ("l2", "one common head of its own"), ("l3", "one common head of its own")]
    tables = []
    monkeypatch.setattr(similarity, "written", lambda df, own=similarity.written: tables.append(own(df)) or tables[-1])
    got = {tuple(r) for r in similarity.clusters(spark.createDataFrame(rows, "key string, text string"), 3, 0.5).collect()}
    assert got == {("k007", "k007", 1.0, 3), ("l0", "k007", 1.0, 3), ("l1", "k007", 7 / 8, 3), ("l2", "l2", 1.0, 2), ("l3", "l2", 1.0, 2)}
    (sets,) = (t for t in tables if "df" in t.columns)
    assert sets.where("uid is not null").count() == 2
    (labels,) = (t for t in tables if "out" in t.columns)
    assert labels.count() == 5


@pytest.mark.parametrize("slots", [1 << 19, 16])
def test_repeated_items_and_first_rows_pass_the_filters(spark, monkeypatch, slots):
    """All items of several rows, at least one row of each set, and few others while the filters aren't full."""
    monkeypatch.setattr(similarity, "SLOTS", slots)
    monkeypatch.setattr(similarity, "MARKS_HELD", 500)
    monkeypatch.setattr(similarity, "PARTS", 4)
    sets = [sorted({1000 * i + k for k in range(40)} | {-i % 7, 5 - i}) for i in range(1, 60)]
    rows = [(i, f"{i}-{copy}", s, 1 + (17 * i + copy) % 255) for i, s in enumerate(sets) for copy in range(20 if i % 3 == 0 else 1)]
    repeated, first = similarity.repeated_items(spark.createDataFrame(rows, "uid long, key string, items array<long>, tag int").repartition(3))
    every, n = np.unique(np.concatenate([s for _, _, s, _ in rows]), return_counts=True)
    passed = repeated(every)
    assert passed[n > 1].all() and (slots == 16 or passed[n == 1].mean() < 0.2)
    uid, tag = (np.array([r[k] for r in rows]) for k in (0, 3))
    own = first(uid, tag)
    assert set(uid[own]) == set(range(len(sets))) and (slots == 16 or own.sum() < 200 < len(rows))


def test_copies_send_their_items_once(spark):
    """Of many copies of a few sets, clusters() sends the items of few rows; the members are the same."""
    rows = [(f"k{i:04}", " ".join(f"w{i % 10}x{k}" for k in range(200)) + (" more" if i % 20 == 0 else "")) for i in range(1000)]
    got = {(r.key, r.rep, r["size"]) for r in similarity.clusters(spark.createDataFrame(rows, "key string, text string").repartition(2), 3, 0.5).collect()}
    assert got == {(f"k{i:04}", f"k{i % 10:04}", 100) for i in range(1000)}
    before = sum(s.shuffleWriteBytes() for s in stages(spark))
    similarity.named_sets(similarity.packed_shingle_sets(spark.createDataFrame(rows, "key string, text string").repartition(2), 3), True, 0.5)
    assert sum(s.shuffleWriteBytes() for s in stages(spark)) - before < 1_500_000  # 16 bytes for each item of each row are 3.2 million


def test_words_are_hashed_side_by_side(spark, monkeypatch):
    """Only very long words are hashed one by one; equal bytes give equal hashes wherever they stand, others different ones, and sets are those of brute force."""
    one_by_one = []
    monkeypatch.setattr(similarity.xxhash, "xxh3_64_intdigest", lambda w, own=similarity.xxhash.xxh3_64_intdigest: one_by_one.append(w) or own(w))
    words = ["", "a", "b", "a\0", "\0", "\0\0", "abcdefgh", "abcdefgh\0", "abcdefghi", "iabcdefgh", "é", "大", "x" * 512, "x" * 513] + [f"w{i}" for i in range(5000)]
    own = pa.array(words)
    hashes = similarity.word_hashes(own)
    assert len(set(hashes.tolist())) == len(words) and one_by_one == [b"x" * 513]
    assert (similarity.word_hashes(own.slice(3, 40)) == hashes[3:43]).all() and (similarity.word_hashes(own.cast(pa.large_string())) == hashes).all() and len(similarity.word_hashes(own.slice(0, 0))) == 0
    r = random.Random(1)
    texts = [" ".join(r.choice("ab") * r.randint(1, 9) for _ in range(r.randint(1, 60))) for _ in range(300)] + ["a b a b a b a", "大阪 is 大 阪", "z"]
    rows = spark.createDataFrame(list(enumerate(texts)), "key long, text string").coalesce(1)
    low = similarity.lowered(rows).orderBy("key").toArrow()
    items, m = similarity.shingled(low["low"].combine_chunks(), 3)
    sets = [shingles(t.replace("大", " 大 ").replace("阪", " 阪 "), 3) for t in texts]
    held = [set(x.tolist()) for x in np.split(items, np.cumsum(m)[:-1])]
    assert m.tolist() == [len(s) for s in sets] == [len(x) for x in held]
    assert all(len(held[a] & held[b]) == len(sets[a] & sets[b]) for a, b in combinations(range(len(texts)), 2))


def test_runs_that_differ_in_their_last_bits_are_told_apart(monkeypatch):
    monkeypatch.setattr(similarity, "mix", lambda x: x)  # sums of words, which are near each other
    monkeypatch.setattr(similarity, "word_hashes", lambda words: np.array([int(w) for w in words.to_pylist()], np.uint64))
    items, m = similarity.shingled(pa.array(["1 3 2 3 1", "5 1 4"] * 40), 1)
    assert items.tolist() == [2, 3, 4, 2, 5, 6] * 40 and m.tolist() == [3, 3] * 40


def test_texts_are_cut_where_they_are_sent(spark, texts):
    """Sets cut from texts by the task that sends them are those of packed_shingle_sets()."""
    frame = spark.createDataFrame(texts, "key string, text string").repartition(3)
    found = []
    for sets, n in ((similarity.packed_shingle_sets(frame, 3), None), (frame, 3)):
        shared, members = similarity.named_sets(sets, True, 0.5, n)
        names = {r.uid: r.rep for r in members.collect()}
        found.append(({(r.key, r.rep, r.copies) for r in members.collect()}, {names[r.uid]: (r.m, r.df) for r in shared.collect()}))
    assert found[0] == found[1] and found[0][1]


@pytest.mark.parametrize("block", [1024, 16])
def test_mean_similarities_of_all_pairs(spark, texts, monkeypatch, block):
    """Clusters of any size are compared in full, from the sets they were found by: texts are cut for the two passes of clusters() only."""
    monkeypatch.setattr(similarity, "BLOCK", block)
    own = dict(texts)
    for i, k in enumerate(k for k, _ in texts[:70]):  # 70 of the copies stand four times more, so that a cluster is larger than 256
        own |= {f"m{i:04}-{c}": own[k] for c in range(4)}
    own |= {"p1": "one pair of copies", "p2": "one pair of copies"}
    read = []
    monkeypatch.setattr(similarity, "lowered", lambda df, of=similarity.lowered: read.append(df) or of(df))
    monkeypatch.setattr(similarity, "shingle_sets", None)
    got = {x.rep: (x.size, x.mean_similarity) for x in similarity.text_pairwise_summary(spark.createDataFrame(list(own.items()), "key string, text string").repartition(4), 3, 0.6).collect()}
    assert len(read) == 1
    members = {}
    for k, r in similarity.clusters(spark.createDataFrame(list(own.items()), "key string, text string"), 3, 0.6).select("key", "rep").collect():
        members.setdefault(r, []).append(shingles(own[k], 3))
    want = {r: (len(v), sum(near(x, y) for x, y in combinations(v, 2)) * 2 / len(v) / (len(v) - 1)) for r, v in members.items()}
    assert max(n for n, _ in want.values()) > 256 and want["p1"] == (2, 1)
    assert all(got[r][0] == n and got[r][1] == pytest.approx(mean, abs=1e-12) for r, (n, mean) in want.items())
    alone = [x for r, x in got.items() if r not in want]
    assert set(alone) == {(1, 1)} and len(alone) == sum(1 for t in own.values() if (t or "").strip()) - sum(n for n, _ in want.values())


def test_masks_are_worked_out_once(spark, monkeypatch):
    """f10_mask_duplicates asks for masked rows twice, and reads the documents for them once."""
    made, tables = [], []
    monkeypatch.setattr(repairs, "masked_keys", lambda t, own=repairs.masked_keys: made.append(own(t)) or made[-1])
    monkeypatch.setattr(repairs.graph, "written", lambda df, own=repairs.graph.written: tables.append(df) or own(df))
    got = repairs.R.queries["f10_mask_duplicates"](spark, "/root/testdata/sf0.001")
    assert len(made) == 1 and any(t is made[0] for t in tables) and got.count() > 0


def test_slider_sends_no_text(spark):
    """Words are counted before texts are joined, in one pass of a text, and as many as before."""
    r = random.Random(5)
    rows = [(f"k{i:03}", f"k{i // 2 * 2:03}", 0.9, " ".join(f"{r.random()}" for _ in range(500))) for i in range(200)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        members, frame = spark.createDataFrame([x[:3] for x in rows], "key string, rep string, similarity double"), spark.createDataFrame([(x[0], x[3]) for x in rows], "key string, text string")
        before = sum(s.shuffleWriteBytes() for s in stages(spark))
        got = similarity.slider(similarity.with_word_counts(members, frame), 0.2).collect()
        assert len(got) == 200 and sum(s.shuffleWriteBytes() for s in stages(spark)) - before < 100_000  # the texts are 1.9 million bytes
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    odd = ["", " ", None, "a", " a\tb\n", "a b", "　大阪 x ", "a\x1cb", "\u0085a b\r\n", "a​b", " \n"]
    counted = {x.text: x.n for x in spark.createDataFrame([(t,) for t in odd], "text string").select("text", word_count(F.col("text")).alias("n")).collect()}
    assert counted == {"": 0, " ": 0, None: 0, "a": 1, " a\tb\n": 2, "a b": 2, "　大阪 x ": 2, "a\x1cb": 1, "\u0085a b\r\n": 2, "a​b": 1, " \n": 0}


def stages(spark):
    store = spark.sparkContext._jsc.sc().statusStore()
    found = store.stageList(spark._jvm.java.util.ArrayList(), False, False, getattr(store, "stageList$default$4")(), getattr(store, "stageList$default$5")())
    return [found.apply(i) for i in range(found.size())]
