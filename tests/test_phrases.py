"""Phrases in texts: automata in blocks against a plain search, and the stream against the batch."""

import random
import re

import pytest

from spanloom.functions import phrases
from spanloom.operators.conventions import found_in_text, row_hits
from spanloom.streaming import live

ROWS = "task_id string, row_index int, input string"


def brute(text, phrase):
    low = (text or "").lower()
    if not phrase:
        return False
    if re.fullmatch(r"[A-Za-z0-9 .\-_']*", phrase):
        return re.search(r"(?<!\w)" + re.escape(phrase) + r"(?!\w)", low) is not None
    return phrase in low


@pytest.fixture(scope="module")
def made(spark):
    r = random.Random(8)
    words = ["Ann", "an", "anna", "東京", "京都", "naïve", "c++", "x_y", "o'neil", "tō", "日本語", "42", "a.b", "É", "ann-marie", "İx"]
    texts = [("".join(r.choice([*words, " ", " ", "-", "."]) for _ in range(r.randint(0, 25)))) for _ in range(150)] + [None, "", "ann" * 2000]
    rows = [(f"t{i % 40}", i, t) for i, t in enumerate(texts)]
    spans = sorted({w.lower() for w in words} | {"ann an", "an.", "京", "anna 東京", "+", ".", "ann-marie", "absent", ""})
    known = [(s, f"type{i % 3}", "active" if i % 5 else "disputed") for i, s in enumerate(spans)]
    known.append((spans[3], "second", "active"))
    return rows, known, spark.createDataFrame(rows, ROWS).repartition(4), spark.createDataFrame(known, "span_lower string, type string, status string")


def expected(rows, known, least, active=False):
    return {(t, i, s, k) for t, i, x in rows for s, k, state in known if len(s) >= least and (not active or state == "active") and brute(x, s)}


def got(frame):
    out = [(r["task_id"], r["row_index"], r["span_lower"], r["convention"]) for r in frame.collect()]
    assert len(out) == len(set(out))
    return set(out)


@pytest.mark.parametrize("characters", [phrases.BLOCK_CHARACTERS, 20])
def test_against_a_plain_search(made, monkeypatch, characters):
    rows, known, texts, conventions = made
    monkeypatch.setattr("spanloom.functions.phrases.phrases_in_text.__defaults__", (phrases.phrases_in_text.__defaults__[0], characters))
    want = expected(rows, known, 1)
    assert len(want) > 500 and got(row_hits(texts, conventions, 1)) == want


def test_most_for_each_task(made):
    rows, known, texts, conventions = made
    per = {}
    for t, i, s, k in expected(rows, known, 2):
        per.setdefault(t, {}).setdefault((s, k), []).append(i)
    found = {}
    for r in found_in_text(texts, conventions, 3, 2).collect():
        found.setdefault(r["task_id"], []).append((r["span_lower"], r["convention"], r["n_rows"]))
    assert found.keys() == per.keys()
    for t, own in found.items():
        best = sorted(per[t], key=lambda x: (-len(x[0]), x[0]))[:3]
        assert sorted(len(s) for s, _, _ in own) == sorted(len(s) for s, _ in best) and all(len(per[t][s, k]) == n for s, k, n in own)


def test_stream_equals_batch(spark, made, tmp_path):
    rows, known, texts, conventions = made
    texts.write.json(str(tmp_path / "in"))
    stream = live.convention_hits(live.row_stream(spark, str(tmp_path / "in"), ROWS), conventions)
    query = stream.writeStream.format("memory").queryName("hits").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert got(spark.table("hits")) == expected(rows, known, 1, active=True) == got(live.convention_hits(texts, conventions))
    assert any("京" in s for _, _, s, _ in got(spark.table("hits")))


def test_nothing_known(spark, made):
    assert row_hits(made[2], made[3].limit(0)).count() == 0
    assert row_hits(made[2].limit(0), made[3]).count() == 0


def test_longest_phrases_are_counted_where_rows_are_read(spark, monkeypatch):
    """Rows of a task in several tasks of Spark, beside others, and phrases in several blocks: the longest few with whole counts, and no more rows sent."""
    from pyspark.sql import functions as F

    from spanloom.operators import conventions

    words = [f"word{c}" for c in "abcdefgh"] + ["words", "a longer one"]
    texts = [(f"t{i % 3}", i, " ".join(w for k, w in enumerate(words) if (i * 7 + k * 5) % 4 < 2)) for i in range(60)]
    rows = spark.createDataFrame(texts, "task_id string, row_index int, input string").repartition(5)
    known = spark.createDataFrame([(w, w[-1]) for w in words], "span_lower string, type string")
    want = set()
    for task in {t for t, _, _ in texts}:
        n = {w: sum(f" {w} " in f" {x} " for t, _, x in texts if t == task) for w in words}
        want |= {(task, w, w[-1], n[w]) for w in sorted((w for w in words if n[w]), key=lambda w: (-len(w), w))[:3]}
    for characters in (1 << 20, 12):
        monkeypatch.setattr("spanloom.functions.phrases.phrases_in_text.__defaults__", ("note", characters))
        assert {tuple(r) for r in conventions.found_in_text(rows, known, 3).select("task_id", "span_lower", "convention", "n_rows").collect()} == want
    monkeypatch.undo()
    one = spark.createDataFrame([("t", w) for w in (" ".join(words),) * 9], "task_id string, input string").coalesce(1)
    sent = phrases.phrases_in_text(one, conventions.convention_phrases(known, 4), F.col("input"), ["task_id"], most=3)
    assert {(r.phrase, r.n_rows) for r in sent.collect()} == {("a longer one", 9), ("worda", 9), ("wordb", 9)} and sent.count() == 3
