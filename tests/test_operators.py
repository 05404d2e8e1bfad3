"""Literal cases for rules that the derived tables don't reach."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.fixtures import Tables
from spanloom.functions.text import first_tokens, shingles, snippet, without_thoughts
from spanloom.operators import consensus, conventions, defects, graph, parse, repair, similarity, stats, workflow
from spanloom.plans import annotation, repairs
from spanloom.sources import registry, tasks
from spanloom.streaming import live


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("x")).first().x


def spans(spark, *rows):
    return spark.createDataFrame([("t", 0, i, *r) for i, r in enumerate(rows)], "task_id string, row_index int, pos int, field string, type string, span string")


def test_text_functions(spark):
    assert one(spark, "<think>a\nb</think>```json\n{}\n```", without_thoughts) == "{}"
    assert one(spark, "日本語 is  nice to read", lambda t: first_tokens(t, 5)) == "日本語 is  nice"
    assert one(spark, "a b", lambda t: first_tokens(t, 5)) == "a b"
    assert one(spark, "A b  c d", lambda t: shingles(t, 3)) == ["a b c", "b c d"] and one(spark, "a b", lambda t: shingles(t, 3)) == ["a b"] and one(spark, " ", lambda t: shingles(t, 3)) == []
    assert one(spark, "x" * 100 + "Key" + "y" * 100, lambda t: snippet(t, F.lit("key"), 3)) == "…xxxKeyyyy…"
    assert one(spark, '["a", {"text": "b", "start": 1}, {"no": 1}]', parse.phrase_text) == ["a", "b"]


def test_parse_annotations(spark):
    good = '{"rows": [{"row_index": 2, "output": {"entities": {"person": ["Ann", "", "Bo"]}, "json_structures": {"act": ["runs fast"]}}}]}'
    frame = spark.createDataFrame([("a", good), ("b", "Sure! " + good + " Done."), ("c", "nothing"), ("d", None)], "task_id string, payload string")
    parsed = parse.parse_annotations(frame)
    assert {r.task_id: r.ok for r in parsed.collect()} == {"a": True, "b": True, "c": False, "d": False}
    got = {(r.row_index, r.field, r.type, r.pos, r.span) for r in parse.explode_spans(parsed.where("task_id = 'b'")).collect()}
    assert got == {(2, "entities", "person", 0, "Ann"), (2, "entities", "person", 2, "Bo"), (2, "json_structures", "act", 0, "runs fast")}
    enum = spark.createDataFrame([("entities", "person")], "field string, type string")
    assert {(r.task_id, r.rule) for r in defects.schema_violations(parsed, enum).collect()} == {("a", "type"), ("b", "type"), ("c", "unreadable"), ("d", "unreadable")}
    more = spark.createDataFrame([("a", '{"rows": 3}'), ("b", '{"rows": []}'), ("c", '{"rows": [{"row_index": 1}]}'), ("d", good)], "task_id string, payload string")
    found = {(r.task_id, r.rule) for r in defects.schema_violations(parse.parse_annotations(more), enum, 1).collect()}
    assert found == {("a", "rows_type"), ("b", "no_rows"), ("c", "row_output"), ("d", "too_many"), ("d", "type")}


def test_payload_round_trip(spark):
    s = spans(spark, ("entities", "a", "x"), ("entities", "a", "w"), ("json_structures", "b", 'q "z"'))
    back = parse.explode_spans(parse.parse_annotations(parse.rebuild_payload(s)))
    assert {(r.field, r.type, r.pos, r.span) for r in back.collect()} == {("entities", "a", 0, "w"), ("entities", "a", 1, "x"), ("json_structures", "b", 0, 'q "z"')}


def test_qc_feedback_and_replies(spark):
    d = spark.createDataFrame([("t", '{"category": "c", "severity": "error", "message": "m", "confidence": 0.5, "failures": [{"message": "x"}, {"severity": "warning"}]}'), ("u", '{"message": "only"}')], "task_id string, decision string")
    got = {(r.task_id, r.at, r.category, r.severity, r.message, r.confidence) for r in parse.qc_feedback(d).collect()}
    assert got == {("t", 0, "c", "error", "x", 0.5), ("t", 1, "c", "warning", "m", None), ("u", 0, None, None, "only", None)}
    replies = spark.createDataFrame([("f", "a"), ("f", " "), ("g", "b"), ("f", "old")], "feedback_id string, message string")
    feedback = spark.createDataFrame([("f",)], "feedback_id string")
    assert [tuple(r) for r in parse.discussion_replies(replies, feedback, replies.where("message = 'old'")).collect()] == [("f", "a")]


def test_collisions_and_shared_types(spark):
    s = spans(spark, ("entities", "a", "X"), ("entities", "b", "X"), ("entities", "a", "Y"), ("json_structures", "b", "X"))
    assert [(r.type, r.span, r.first_type) for r in defects.type_collisions(s).collect()] == [("b", "X", "a")]
    enum = spark.createDataFrame([("entities", "s"), ("json_structures", "s"), ("entities", "e")], "field string, type string")
    s = spans(spark, ("entities", "s", "two words"), ("json_structures", "s", "one"), ("json_structures", "s", "three of them"))
    assert {(r.span, r.should) for r in defects.misplaced_shared(s, enum).collect()} == {("two words", "json_structures"), ("one", "entities")}
    fixed = repair.rerouted(s, enum)
    assert defects.misplaced_shared(fixed, enum).count() == 0 and fixed.where("moved").count() == 2


def test_alignment(spark):
    rows = spark.createDataFrame([("t", 0, "He said: big   red\tbarn, twice")], "task_id string, row_index int, input string")
    got = {r.span: r.fixed for r in repair.aligned(spans(spark, *(("entities", "a", x) for x in ('"red', "big red barn", "big", "absent", "barn."))), rows).collect()}
    assert got == {'"red': "red", "big red barn": "big   red\tbarn", "big": "big", "absent": None, "barn.": "barn"}


def longest_common(text, span):
    """The longest run of the span that the text holds, by comparing all places."""
    best = (0, 0)
    for i in range(len(text)):
        for j in range(len(span)):
            n = 0
            while i + n < len(text) and j + n < len(span) and text[i + n] == span[j + n]:
                n += 1
            best = max(best, (n, -i))
    return best[0], -best[1]


def test_recovery_of_spans(spark):
    text = "The quick Brown fox  jumps over the lazy dog near Zürich"
    values = ["Brown", "brown FOX", "  quick ", "over  the", "lazy dogs", "lazy cats", "near Zurich", "jumps ovr", "xyz", "", "near Zürichs"]
    rows = spark.createDataFrame([("t", 0, text)], "task_id string, row_index int, input string")
    got = {r.span: r.fixed for r in repair.recovered(spans(spark, *(("entities", "a", v) for v in values)), rows).collect()}
    want = {"Brown": "Brown", "brown FOX": "Brown fox", "  quick ": "quick", "over  the": "over the", "": None}
    for v in values:
        if v not in want:
            n, at = longest_common(text.lower(), v.lower())
            want[v] = text[at : at + n] if n >= max(4, int(len(v) * 0.7)) else None
    assert got == want and want["lazy dogs"] == "lazy dog" and want["xyz"] is None
    clean = repair.autocleaned(spans(spark, ("entities", "a", "lazy dog."), ("entities", "b", "lazy dog"), ("entities", "a", "absent"), ("notes", "a", "fox"), ("json_structures", "b", "lazy dog")), rows)
    assert {(r.field, r.type, r.span) for r in clean.collect()} == {("entities", "a", "lazy dog"), ("json_structures", "b", "lazy dog")}


def test_row_inputs(spark):
    s = spark.createDataFrame([("t", [(None, "a"), (5, "b"), (0, "c"), (None, None)])], "task_id string, rows array<struct<row_index: int, input: string>>")
    assert {(r.row_index, r.input) for r in parse.row_inputs(s).collect()} == {(0, "c"), (5, "b")}


def test_placeholders(spark):
    s = spans(spark, ("entities", "a", "XXXX"), ("entities", "time", "XXXX"), ("entities", "a", "XX"), ("entities", "a", "[REDACTED]"), ("entities", "a", "a***b"))
    assert {r.span for r in defects.placeholders(s).collect()} == {"XXXX", "[REDACTED]", "a***b"}


def test_prior_rules(spark):
    counts = [("apple", "org", 8), ("apple", "tech", 2), ("few", "org", 9), ("ms", "a", 5), ("ms", "b", 5)]
    summary = stats.summaries(spark.createDataFrame(counts, "span_lower string, type string, n long"))
    decisions = spark.createDataFrame([("t", "apple", "tech"), ("t", "apple", "org"), ("t", "few", "x"), ("t", "ms", "c"), ("t", "new", "x")], "task_id string, span_lower string, type string")
    got = {(r.span_lower, r.type): r.verdict for r in stats.prior_check(decisions, summary).collect()}
    assert got == {("apple", "tech"): "divergent", ("apple", "org"): "agree", ("few", "x"): "cold_start", ("ms", "c"): "agree", ("new", "x"): "cold_start"}
    assert [(r.span_lower, r.top_type) for r in stats.contested(summary).collect()] == [("ms", "b")]


def test_conventions_fold(spark):
    p = [("a", 1, "x", "qc", "t1"), ("a", 2, "x", "qc", "t1"), ("a", 3, "y", "qc", "t2"), ("b", 1, "x", "qc", "t1"), ("b", 2, "y", "declared:op", "t2"), ("c", 1, "x", "qc", "t1")]
    got = {r.span_lower: (r.type, r.status, r.evidence, r.locked) for r in conventions.from_proposals(spark.createDataFrame(p, "span_lower string, seq int, type string, source string, task_id string")).collect()}
    assert got == {"a": ("x", "disputed", 2, False), "b": ("y", "active", 2, True), "c": ("x", "active", 1, False)}


def test_scores_without_denominators(spark):
    none = spark.createDataFrame([], "pass int, id string, span string, fp_delta int, fn_delta int")
    got = consensus.majority_score(none, spans(spark)).first()
    assert (got.precision, got.recall, got.f1, got.passed) == (1.0, 1.0, 1.0, True)


def test_annotators_and_opinions(spark):
    t = spark.createDataFrame([("t", "text", ["a"]), ("u", "text", ["z"])], "task_id string, modality string, types array<string>")
    a = spark.createDataFrame([("2", True, ["text"], ["a", "b"]), ("1", False, ["text"], ["a"]), ("3", True, ["text"], ["a"])], "annotator_id string, enabled boolean, modalities array<string>, types array<string>")
    assert {r.task_id: r.annotator_id for r in consensus.choose_annotator(t, a).collect()} == {"t": "2", "u": None}
    c = spark.createDataFrame([("x", "p", "q", "p", 0.9), ("y", "p", "q", "q", 0.9), ("z", "p", "q", "r", 0.9), ("w", "p", "q", None, 0.9), ("v", "p", "q", "p", 0.1)], "span string, first string, prior string, second string, confidence double")
    assert {r.span: r.action for r in consensus.second_opinions(c).collect()} == {"x": "keep", "y": "flip", "z": "review", "w": "review", "v": "review"}


def test_components_of_random_graphs(spark):
    r = random.Random(4)
    edges = [(r.randrange(90), r.randrange(90)) for _ in range(60)]
    got = {x.node: x.root for x in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for a, b in edges:
        assert got[a] == got[b] <= min(a, b)
    assert all(got[v] == v for v in set(got.values()))


def brute_edges(rows, n, threshold):
    sets, first = {}, {}
    for k, text in rows:
        w = text.lower().split()
        s = frozenset(" ".join(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))) if w else frozenset()
        if s and s not in first:
            first[s] = k
            sets[k] = s
    return {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


@pytest.mark.parametrize(("rare", "block", "threshold", "n"), [(64, 1024, 0.5, 3), (2, 4, 0.7, 2)])
def test_edges_by_brute_force(spark, monkeypatch, rare, block, threshold, n):
    """Texts with a common head and copies with a few words changed, also where most items count as frequent and blocks are small."""
    monkeypatch.setattr(similarity, "RARE", rare)
    monkeypatch.setattr(similarity, "BLOCK", block)
    r = random.Random(1)
    texts = []
    for _ in range(250):
        if texts and r.random() < 0.5:
            w = r.choice(texts).split()
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice("abcdefgh")
            texts.append(" ".join(w[: r.randint(1, len(w))] if r.random() < 0.3 else w))
        else:
            texts.append(" ".join(["x", "y", "z", "common", *(r.choice("abcdefgh") + str(r.randint(0, 9)) for _ in range(r.randint(0, 12)))]))
    rows = [(f"k{i:04}", x) for i, x in enumerate(texts)]
    frame = spark.createDataFrame(rows, "key string, text string")
    want = brute_edges(rows, n, threshold)
    got = {(x.a, x.b): x.similarity for x in similarity.near_duplicate_edges(frame, n, threshold).collect()}
    assert got == pytest.approx(want) and len(want) > 10
    sets, _ = similarity.distinct_sets(similarity.shingle_sets(frame, n))
    near = {}
    for a, b in want:
        near.setdefault(a, {a}).add(b)
        near.setdefault(b, {b}).add(a)
    names = {x.uid: x.key for x in sets.select("uid", "key").collect()}
    roots = {}
    for x in similarity.components(sets, threshold).collect():
        roots.setdefault(x.root, set()).add(names[x.node])
    reached = set()
    for start in near:
        seen, todo = {start}, [start]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        reached.add(frozenset(seen))
    assert {frozenset(x) for x in roots.values()} == reached


def test_a_common_shingle_makes_no_pairs(spark):
    """Rows that share one shingle and differ in all else: candidates don't grow with the square of the rows."""
    rows = spark.range(3000).select(F.format_string("k%05d", "id").alias("key"), F.concat(F.lit("one common head "), F.col("id").cast("string"), F.lit("a "), F.col("id").cast("string"), F.lit("b")).alias("text"))
    sets, _ = similarity.distinct_sets(similarity.shingle_sets(rows, 3))
    assert sets.count() == 3000 and similarity.exact_candidates(sets, 0.5).count() == 0


def test_recall_of_signatures(spark):
    """The edges that bands of signatures find, of those that the exact mode finds."""
    t = repairs.task_texts(Tables(spark, "/root/testdata/sf0.01"))
    exact, lsh = ({(r.a, r.b) for r in similarity.near_duplicate_edges(t, 5, 0.7, mode).collect()} for mode in ("exact", "lsh"))
    assert lsh <= exact and len(lsh) >= 0.9 * len(exact) > 0


def test_mean_pairwise_values(spark):
    r = np.random.default_rng(3)
    vectors = [(int(i % 3), [float(x) for x in r.normal(size=5)]) for i in range(12)] + [(7, [1.0] * 5), (1, [0.0] * 5), (1, None)]
    got = {x.cluster: (x.size, x.mean_cosine) for x in similarity.mean_pairwise_cosine(spark.createDataFrame(vectors, "label int, embedding array<double>"), "label").collect()}
    for c in range(3):
        own = similarity.unit(np.array([v for k, v in vectors[:12] if k == c]))
        assert got[c] == (4, pytest.approx((own @ own.T)[np.triu_indices(4, 1)].mean()))
    assert got[7] == (1, 1.0)
    signatures = {f"k{i}": [int(x) for x in r.integers(0, 3, 8)] for i in range(6)}
    members = [(k, "k0" if i < 5 else "k5") for i, k in enumerate(signatures)]
    out = {x.rep: (x.size, x.mean_similarity) for x in similarity.mean_pairwise_jaccard(spark.createDataFrame(members, "key string, rep string"), spark.createDataFrame(list(signatures.items()), "key string, signature array<long>")).collect()}
    pairs = [np.mean(np.array(signatures[f"k{i}"]) == np.array(signatures[f"k{j}"])) for i in range(5) for j in range(i)]
    assert out == {"k0": (5, pytest.approx(np.mean(pairs))), "k5": (1, 1.0)}


def test_diverse_examples_by_brute_force(spark):
    r = random.Random(5)
    texts = [(g, " ".join(r.choice("abcde") for _ in range(r.randint(1, 9)))) for g in "xyz" for _ in range(12)] + [("w", "only one"), ("w", "only one")]
    got = {}
    for x in similarity.diverse_examples(spark.createDataFrame(texts, "g string, text string"), ["g"], 4).orderBy("rank").collect():
        got.setdefault(x.g, []).append(x.text)
    grams = lambda t: {tuple(t.split()[i : i + 3]) for i in range(max(len(t.split()) - 2, 1))}
    for g in "wxyz":
        rest = sorted({t for k, t in texts if k == g})
        chosen = [rest.pop(0)]
        while rest and len(chosen) < 4:
            best = min(rest, key=lambda t: (max(len(grams(t) & grams(c)) / len(grams(t) | grams(c)) for c in chosen), t))
            chosen.append(best)
            rest.remove(best)
        assert got[g] == chosen


def test_diverse_examples_keep_hashes(spark, monkeypatch):
    """What the rounds write are hashes, not words, and the chosen ones come with theirs: no join but one of each round after the first."""
    tables = []
    monkeypatch.setattr(similarity, "written", lambda df, own=similarity.written: tables.append(df) or own(df))
    frame = spark.createDataFrame([("g", f"a b c d {i}") for i in range(5)] + [("h", "one"), ("h", " "), ("h", None)], "g string, text string")
    similarity.diverse_examples(frame, ["g"], 3)
    assert all(f.dataType.simpleString() == "array<bigint>" for t in tables for f in t.schema if f.name in ("items", "own"))
    assert sum(t._jdf.queryExecution().optimizedPlan().toString().count("Join ") for t in tables) == 2


def test_embedding_map_finds_groups(spark):
    r = np.random.default_rng(1)
    points = np.concatenate([r.normal(c, 0.05, (30, 4)) for c in (0, 3, 6)] + [[[20.0, -9, 4, 1]]])
    out = {x.vec_id: x.cluster for x in similarity.embedding_map(spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(points)], "vec_id long, embedding array<double>"), 0.8, 4).collect()}
    assert [out[i] for i in range(91)] == [0] * 30 + [30] * 30 + [60] * 30 + [None]


def test_numbers_by_ranges(spark):
    frame = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("x"), F.lit("pad").alias("n"))
    out = graph.numbered(frame.repartition(7), ["x"], "place").collect()
    assert len(out) == 1000 and all(r.place == r.x for r in out)


def test_ratio_samples(spark):
    frame = spark.range(997).select(F.format_string("t%04d", "id").alias("task_id"), F.lit("accepted").alias("status"))
    order = [r.task_id for r in frame.orderBy(F.md5(F.concat(F.lit("0|"), "task_id"))).collect()]
    assert {r.task_id for r in consensus.task_sample(frame, ratio=0.25).collect()} == set(order[:250])
    assert consensus.task_sample(frame, ratio=0.0000001).count() == 1 and consensus.task_sample(frame, ratio=1.0).count() == 997


def test_conventions_in_scripts_without_blanks(spark):
    rows = spark.createDataFrame([("t", 0, "私は東京大学院へ行く"), ("t", 1, "Über naïveté and ++ code"), ("t", 2, "scattered catalog")], "task_id string, row_index int, input string")
    known = spark.createDataFrame([("東京大学", "org"), ("naïveté", "word"), ("++ code", "sign"), ("scat", "no"), ("catalog", "yes")], "span_lower string, type string")
    assert {r.span_lower for r in conventions.found_in_text(rows, known).collect()} == {"東京大学", "naïveté", "++ code", "catalog"}


def test_clusters_hold_to_their_representative(spark):
    r = random.Random(6)
    texts = []
    for i in range(60):
        w = r.choice(texts)[1].split() if texts and i % 2 else [r.choice("abcdefgh") * r.randint(1, 3) for _ in range(20)]
        w[r.randrange(len(w))] = "zz"
        texts.append((f"k{i:03}", " ".join(w)))
    frame = spark.createDataFrame(texts, "key string, text string")
    got = similarity.clusters(frame, 2, 0.4, frame.where("key = 'k000'").select("key"))
    assert got.where("similarity < 0.4 or size < 2").count() == 0 and got.where("key = rep").count() == got.select("rep").distinct().count()
    masks = similarity.mask_duplicates(got, frame.limit(0))
    assert similarity.mask_duplicates(got, masks).count() == 0 and masks.count() == similarity.rejects(got).count() > 0


def test_embedding_hook_and_cache(spark):
    texts = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", None)], "key string, text string")
    vectors = similarity.embed(texts, similarity.random_embedder(8), 8)
    got = {r.key: np.array(r.vector) for r in vectors.collect()}
    assert np.allclose(got["a"], got["b"]) and not np.allclose(got["a"], got["c"])
    items = texts.select("key", similarity.content_hash(F.coalesce("text", F.lit(""))).alias("content_hash"))
    cache = similarity.cache_upsert(spark.createDataFrame([], "key string, content_hash string, vector array<float>"), items.join(vectors, "key"))
    hits, misses = similarity.cache_lookup(items, cache, 8)
    assert hits.count() == 3 and misses.count() == 0 and similarity.cache_lookup(items, cache, 9)[1].count() == 3
    now = similarity.fingerprint(texts)
    assert similarity.report_state(now, now).first().state == "fresh" and similarity.report_state(now.limit(0), now).first().state == "missing"


def test_zero_durations_and_bad_moves(spark):
    at = "timestamp'2024-01-01 00:00:00'"
    attempts = spark.sql(f"select 't' task_id, 1 seq, 'qc' stage, 'succeeded' status, {at} finished_at, 0.0D dur_s, 'm' provider_id union all select 't', 2, 'qc', 'succeeded', {at}, 2.0D, 'n'")
    got = workflow.throughput(attempts, F.expr(at), 5).first()
    assert (got.n, got.mean_s) == (1, 2.0)
    events = spark.createDataFrame([("t", 1, "draft", "pending"), ("t", 2, "annotating", "qc"), ("t", 3, "qc", "draft")], "task_id string, seq int, previous_status string, next_status string")
    assert {(r.seq, r.broken) for r in workflow.illegal_moves(events, workflow.transitions(spark)).collect()} == {(2, True), (3, False)}


def test_jsonl_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "n int, text string")
    tasks.write_training_data(rows, str(tmp_path / "out"))
    assert sorted(map(tuple, tasks.read_jsonl(spark, str(tmp_path / "out"), "n int, text string").collect())) == [(1, "a"), (2, None)]
    (tmp_path / "bad.jsonl").write_text('{"n": 1}\n\nnot json\n')
    assert [(r.n, r["_corrupt_record"]) for r in tasks.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "n int", tolerant=True).collect()] == [(1, None), (None, "not json")]
    with pytest.raises(Exception, match="(?i)malformed"):
        tasks.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "n int").collect()
    (tmp_path / "dir/a").mkdir(parents=True)
    (tmp_path / "dir/a/t1.task.json").write_text('{"task_id": "t1",\n "status": "accepted"}')
    (tmp_path / "dir/a/t1.jsonl").write_text('{"row_index": 0, "text": "hi"}\n')
    assert [(r.task_id, r.input) for r in tasks.read_task_directory(spark, str(tmp_path / "dir"), "accepted").collect()] == [("t1", "hi")]


def test_streams_equal_batches(spark, tmp_path):
    attempts = spark.sql("select 't' task_id, 'qc' stage, 'succeeded' status, timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(id * 3 as int)) finished_at, 1.0D dur_s from range(50)")
    attempts.write.parquet(str(tmp_path / "in"))
    for name, twin in (("w", lambda d: live.throughput(d)), ("s", lambda d: live.throughput(d, slide="1 minute")), ("g", lambda d: live.sessions(d))):
        stream = twin(spark.readStream.schema(attempts.schema).parquet(str(tmp_path / "in")))
        q = stream.writeStream.format("memory").queryName(name).outputMode("complete" if name != "g" else "append").option("checkpointLocation", str(tmp_path / f"c{name}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        got, want = (sorted(map(tuple, f.collect())) for f in (spark.table(name), twin(attempts)))
        assert got == want if name != "g" else set(got) <= set(want) and len(got) >= len(want) - 1  # the last session is still open


def test_stale_runs_and_bad_moves_on_streams(spark, tmp_path):
    """Files arrive one by one: a run is reported once its time is over, one that beats again isn't; events that come twice count once."""
    for key, value in live.STATE_STORE.items():
        spark.conf.set(key, value)
    at = lambda s: f"2024-01-01 00:{s // 60:02}:{s % 60:02}"
    beats = [[(1, at(0)), (2, at(0))], [(2, at(500))], [(3, at(1000))], [(3, at(1500)), (3, at(1400))]]
    moves = [[("t", 1, "draft", "pending"), ("t", 2, "pending", "annotating")], [("t", 2, "pending", "annotating"), ("t", 3, "annotating", "draft"), ("u", 1, "draft", "pending")], [("t", 4, "qc", "accepted"), ("u", 2, "pending", "annotating")]]
    schemas = "run_id long, heartbeat_at timestamp", "task_id string, seq long, previous_status string, next_status string"
    for name, batches, schema, twin in (("beats", beats, schemas[0], lambda s: live.stale_alerts(s, 600)), ("moves", moves, schemas[1], lambda s: live.status_changes(s, [(a, b) for a, bs in workflow.ALLOWED.items() for b in bs]))):
        columns = [c.split()[0] for c in schema.split(", ")]
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, ", ".join(f"{c} {'string' if c == 'heartbeat_at' else s.split()[1]}" for c, s in zip(columns, schema.split(", "), strict=True))).coalesce(1).write.json(str(tmp_path / f"{name}{i}"))
        stream = twin(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / f"{name}*")))
        q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"c{name}")).trigger(availableNow=True).start()
        q.awaitTermination(180)
    assert {r.run_id for r in spark.table("beats").collect()} == {1, 2}
    out = {(r.task_id, r.seq): (r.legal, r.chained) for r in spark.table("moves").collect()}
    assert out == {("t", 1): (True, True), ("t", 2): (True, True), ("t", 3): (False, True), ("t", 4): (True, False), ("u", 1): (True, True), ("u", 2): (True, True)}
    assert spark.table("moves").count() == 6 and live.bad_moves(spark.table("moves")).count() == 2


def test_statistics_stream_counts_once(spark, tmp_path):
    rows = spark.sql("select concat('t', id % 3) task_id, 'a' span_lower, 'x' type, timestamp'2024-01-01 00:00:00' ts from range(9)")
    rows.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        live.keep_statistics(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    assert [tuple(r) for r in live.read_statistics(spark, str(tmp_path / "out")).collect()] == [("a", "x", 3)]


def test_lsh_edges_of_a_group(spark, monkeypatch):
    """Edited copies of one text are all linked with each other, not only with the first of their bucket, whatever the blocks."""
    monkeypatch.setattr(similarity, "BLOCK", 5)
    words = [f"w{i}" for i in range(300)]
    texts = [(f"g{k:02d}", " ".join([*words[: 20 * k], f"edit{k}", *words[20 * k + 1 :]])) for k in range(14)] + [(f"other{k}", " ".join(f"{k}x{i}" for i in range(50))) for k in range(5)]
    frame = spark.createDataFrame(texts, "key string, text string")
    exact, lsh = ([(r.a, r.b, round(r.similarity, 9)) for r in similarity.near_duplicate_edges(frame, 5, 0.7, mode).collect()] for mode in ("exact", "lsh"))
    assert len(lsh) == 14 * 13 // 2 and sorted(lsh) == sorted(exact)


def test_ids_above_six_digits(spark, tmp_path):
    """Documents from 1,000,000 on keep tasks, rows, spans and cache keys of their own."""
    ids = [7, 999_999, *range(1_000_000, 1_000_010), 10_000_000]
    spark.createDataFrame([(i, f"Text number{i}") for i in ids], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, [1.0] * 64, 0) for i in ids], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    t = Tables(spark, str(tmp_path))
    want = sorted(f"doc-{i:06d}" for i in ids)
    for table in (t.tasks, t.rows, t.spans):
        assert sorted(r.task_id for r in table.select("task_id").collect()) == want
    assert sorted(r.key for r in repairs.cached(t)[1].select("key").collect()) == want


def test_migrated_ids_above_six_digits(spark):
    n = 1_000_012
    own = spark.range(n).select(F.format_string("t%08d", "id").alias("task_id"))
    out = tasks.migrate(own.withColumn("status", F.lit("accepted")), own.withColumn("usable", F.lit(True)), "v5")
    assert out.agg(F.countDistinct("new_id").alias("n"), F.max("new_id").alias("last")).first() == (n, "v5-999999")
    assert out.where("task_id = 't01000011'").first().new_id == "v5-1000012"


def test_queries_of_the_whole_job(spark, tmp_path):
    """The fingerprint as a query sees a changed text; deviations and unjustified masks come from all tasks and from recorded representatives."""
    prints = []
    for name, text in (("a", "Some text"), ("b", "Some text"), ("c", "Some tent")):
        spark.createDataFrame([(1, text), (2, "other")], "doc_id long, text string").write.parquet(str(tmp_path / name / "documents.parquet"))
        prints.append(repairs.R.queries["f17_text_fingerprint"](spark, str(tmp_path / name)).first())
    assert prints[0] == prints[1] and prints[0].n_texts == prints[2].n_texts == 2 and prints[0].fingerprint != prints[2].fingerprint
    sf = "/root/testdata/sf0.001"
    deviations = annotation.R.queries["e12_all_task_deviations"](spark, sf).select("task_id").distinct().collect()
    assert any(r.task_id >= "doc-000050" for r in deviations)
    assert len(repairs.R.queries["f19_unjustified_duplicate_masks"](spark, sf).select("rep").distinct().collect()) > 1


def test_deviations_one_by_one(spark):
    """The query lists each deviation of each task, with the counts of its task."""
    rows = annotation.R.queries["e12_task_deviations"](spark, "/root/testdata/sf0.001").collect()
    each = {(r.task_id, r.span_lower, r.type) for r in rows}
    assert len(each) == len(rows) > len({r.task_id for r in rows}) and max(r.task_id for r in rows) >= "doc-000050"
    assert all(r.n == sum(t == r.task_id for t, _, _ in each) for r in rows)


def test_cosine_search_a_few_cosines_at_a_time(spark, monkeypatch):
    """However many queries there are, a task holds a bounded number of cosines."""
    monkeypatch.setattr(similarity, "PAIRS", 60)
    r = np.random.default_rng(3)
    x = r.standard_normal((200, 8)).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)], "vec_id long, embedding array<float>")
    got = {(q.query, q.vec_id) for q in similarity.cosine_search(frame.where("vec_id % 4 = 0"), frame, 0.5).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert got == {(int(q), int(v)) for q, v in zip(*np.nonzero(u @ u.T >= 0.5), strict=True) if q % 4 == 0 and q != v} and got


def test_only_shared_items_are_compared(spark):
    """Of each set the items that another has too, the rarest first, with its whole size; similarities from these are those of the whole sets."""
    sets = spark.createDataFrame([(1, [1, 2, 3, 4, 5]), (2, [2, 3, 4, 5, 6, 7]), (3, [5, 90, 91]), (4, [80])], "uid long, items array<long>")
    shared = similarity.shared_sets(sets)
    assert {r.uid: (r.m, r["items"], r.df) for r in shared.collect()} == {1: (5, [2, 3, 4, 5], [2, 2, 2, 3]), 2: (6, [2, 3, 4, 5], [2, 2, 2, 3]), 3: (3, [5], [3])}
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "a long, b long")
    assert {(r.a, r.b): round(r.similarity, 9) for r in similarity.verified(pairs, shared, 0.1).collect()} == {(1, 2): round(4 / 7, 9), (1, 3): round(1 / 7, 9), (2, 3): 0.125}


def test_sets_are_counted_without_being_written(spark, monkeypatch):
    """Copies, short, blank and unspaced texts: the sets of shingle_sets(), each once, and no table of whole sets in the shared folder."""
    texts = ["a b c d e", "A  b\tc d e", "a b c d f", "a b", "a b", "b a", " ", "", "大阪 x y", "a b c\u00a0d", "z"] + [f"q w {i}" for i in range(40)]
    frame = spark.createDataFrame([(f"k{i:03}", x) for i, x in enumerate(texts)] + [("none", None)], "key string, text string")
    plain, whole = ({r.key: set(r["items"]) for r in of(frame, 3).collect()} for of in (similarity.shingle_sets, similarity.packed_shingle_sets))
    assert plain.keys() == whole.keys()
    assert all((len(plain[a] & plain[b]), len(plain[a])) == (len(whole[a] & whole[b]), len(whole[a])) for a in plain for b in plain)
    tables = []
    monkeypatch.setattr(similarity, "written", lambda df, own=similarity.written: tables.append(own(df)) or tables[-1])
    shared, members = similarity.named_sets(similarity.packed_shingle_sets(frame, 3))
    rep = {k: min(b for b in plain if plain[b] == plain[k]) for k in plain}
    assert {r.key: r.rep for r in members.collect()} == rep
    names = {r.uid: r.rep for r in members.collect()}
    df = {}
    for k in set(rep.values()):
        for i in whole[k]:
            df[i] = df.get(i, 0) + 1
    want = {k: (len(whole[k]), sorted((df[i], i) for i in whole[k] if df[i] > 1)) for k in set(rep.values()) if any(df[i] > 1 for i in whole[k])}
    assert {names[r.uid]: (r.m, list(zip(r.df, r["items"], strict=True))) for r in shared.collect()} == want
    assert all("items" not in t.columns or "df" in t.columns for t in tables)


def test_annotations_as_models_write_them(spark):
    row = '{"rows": [{"row_index": 0, "output": {"entities": {"person": ["Ann"]}}}]}'
    fenced = f"<think>which {{rows}}?</think>\n```json\n{row}\n```"
    kinds = {"h": "human_review_answer", "a": "annotation_result"}
    data = [("fenced", 1, "a", fenced), ("prose", 1, "a", f"Sure! {row} Done."), ("list", 1, "a", row), ("back", 1, "a", fenced), ("back", 2, "a", ""), ("back", 3, "a", '{"rows": ['), ("human", 1, "h", row), ("human", 2, "a", row)]
    data += [("person", 1, "a", row), ("person", 2, "h", "{broken"), ("none", 1, "a", None), ("array", 1, "a", "[1]"), ("empty", 1, "a", '{"rows": []}')]
    frame = spark.createDataFrame([(t, s, kinds[k], p) for t, s, k, p in data], "task_id string, seq int, kind string, payload string")
    usable = {r.task_id: (r.seq, r.usable) for r in parse.effective_annotation(frame).collect()}
    assert usable == {"fenced": (1, True), "prose": (1, True), "list": (1, True), "back": (3, False), "human": (1, True), "person": (2, False), "none": (1, False), "array": (1, False), "empty": (1, True)}
    # a human answer that can't be read ends the search
    assert {r.task_id: r.seq for r in parse.last_readable_annotation(frame).collect()} == {"fenced": 1, "prose": 1, "list": 1, "back": 1, "human": 1, "empty": 1}


def test_no_name_is_defined_twice():
    import ast
    from collections import Counter
    from pathlib import Path

    for path in Path(repair.__file__).parents[1].rglob("*.py"):
        names = Counter(x.name for x in ast.parse(path.read_text()).body if isinstance(x, ast.FunctionDef | ast.ClassDef))
        assert not [n for n, k in names.items() if k > 1], path


def test_settled_disputes_and_runs(spark):
    """Against a plain walk over each span's proposals, with runs so short that repeats fall on their seams."""
    r = random.Random(12)
    sources = ["qc_consensus", "arbiter_correction", "declared:ann", "dispute_resolved_by:bo"]
    events = [(s, i, r.choice("xy"), r.choice([None, "t1", "t2"]), r.choices(sources, [6, 3, w, w])[0]) for s, n, w in (("hot", 300, 0.05), ("calm", 40, 0), ("settled", 60, 1), ("one", 1, 0)) for i in range(n)]
    want = {}
    for span in ("hot", "calm", "settled", "one"):
        kind = by = last = None
        locked, n, kinds, tasks = False, 0, set(), set()
        for _, _, t, task, source in (e for e in events if e[0] == span):
            if last == (t, source, task) and not source.startswith("dispute"):
                continue
            last, n, kinds, tasks = (t, source, task), n + 1, kinds | {t}, tasks | {task}
            operator = source.startswith(("declared:", "dispute_resolved_by:"))
            if operator or kind is None:
                kind, by = t, source
            locked |= operator
        want[span] = (kind, "active" if locked or len(kinds) == 1 else "disputed", by, n, len(tasks - {None}), locked)
    frame = spark.createDataFrame(events, "span_lower string, seq long, type string, task_id string, source string").repartition(5)
    for run in (1, 7, conventions.RUN):
        got = {x.span_lower: tuple(x)[1:] for x in conventions.from_proposals(frame, run).collect()}
        assert got == want


@pytest.mark.parametrize(("frame", "size"), [(5, 16), (8, 8), (1, 4), (200, 1 << 16)])
def test_rescaled_in_ranges(spark, frame, size):
    r = random.Random(frame)
    data = [(r.choice("aab"), i, r.choice([None, float(r.randint(0, 9))])) for i in range(150)]
    rows = spark.createDataFrame(data, "k string, i int, v double").repartition(4)
    got = {x.i: x.scaled for x in consensus.rescaled(rows, "k", "v", ["i"], frame, 3, size).collect()}
    for k in "ab":
        own = [x for x in data if x[0] == k]
        for at, (_, i, v) in enumerate(own):
            seen = [x[2] for x in own[max(0, at - frame + 1) : at + 1]]
            known = [x for x in seen if x is not None]
            flat = len(seen) < 3 or (known and min(known) == max(known))
            assert got[i] == (v if flat or v is None else (v - min(known)) / (max(known) - min(known)))


def test_names_of_adapters_validators_and_sinks(spark, tmp_path):
    (tmp_path / "dir").mkdir()
    (tmp_path / "dir/t1.task.json").write_text('{"task_id": "t1", "status": "accepted"}')
    (tmp_path / "dir/t1.jsonl").write_text('{"row_index": 0, "text": "Ann runs."}\n')
    registry.moved(spark, "task_directory", str(tmp_path / "dir"), "jsonl", str(tmp_path / "out"), status="accepted")
    rows = registry.ADAPTERS["jsonl"](spark, str(tmp_path / "out"), "task_id string, row_index int, input string")
    spans_ = spark.createDataFrame([("t1", 0, 0, "entities", "person", "Ann"), ("t1", 0, 1, "entities", "person", "Bob"), ("t1", 0, 2, "entities", "verb", "Ann")], "task_id string, row_index int, pos int, field string, type string, span string")
    assert {(r.rule, r.pos) for r in registry.violations(spans_, rows).collect()} == {("verbatim", 1), ("collision", 2)}
    registry.VALIDATORS.register("short", lambda spans, rows: spans.where("length(span) < 4"))
    try:
        assert registry.violations(spans_, rows, ["short"]).count() == 3 and "short" in registry.VALIDATORS.names()
    finally:
        del registry.VALIDATORS.known["short"]
    with pytest.raises(KeyError, match="no sink is called 'tape'; there are jsonl, parquet"):
        registry.SINKS["tape"]


@pytest.mark.parametrize("few", [100_000, 0])
def test_batches_of_few_and_many_groups(spark, monkeypatch, few):
    monkeypatch.setattr(tasks, "FEW_GROUPS", few)
    r = random.Random(1)
    data = [(i, r.choice(["a", "b", None, "c"]), r.choice("xy")) for i in range(200)]
    groups: dict[tuple, list[int]] = {}
    for i, a, b in data:
        groups.setdefault((a or "", b), []).append(i)
    want, number = {}, 0
    for own in groups.values():
        for k, i in enumerate(own):
            want[i] = number + k // 7
        number += -(-len(own) // 7)
    frame = spark.createDataFrame(data, "line int, k string, j string").repartition(5)
    assert {x.line: x.task_no for x in tasks.batches(frame, 7, ["k", "j"], "line").collect()} == want
