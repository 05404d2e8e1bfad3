"""Recovery of spans: the automaton against brute force, places behind characters whose lower case is longer, and time."""

import random
import re
import time

import pytest

from spanloom.functions import runs
from spanloom.functions.runs import Runs, lowered
from spanloom.functions.text import snippet
from spanloom.operators.repair import recovered


def brute_run(text, value):
    """Start and size of the longest common run, the first in the text."""
    for size in range(min(len(text), len(value)), 0, -1):
        for start in range(len(text) - size + 1):
            if text[start : start + size] in value:
                return start, size
    return 0, 0


def brute(span, text):
    if text is None:
        return span
    if not span or not text:
        return None
    low, at = "", []
    for i, c in enumerate(text):
        low += c.lower()
        at += [i] * len(c.lower())
    lower = lambda x: "".join(c.lower() for c in x)
    for value in (span, span.strip(), re.sub(r"\s+", " ", span).strip()):
        if value and value in text:
            return value
        if value and lower(value) in low:
            start = low.index(lower(value))
            return text[at[start] : at[start + len(lower(value)) - 1] + 1]
    start, size = brute_run(low, lower(span))
    return text[at[start] : at[start + size - 1] + 1] if size >= max(4, int(len(span) * 0.7)) else None


def test_automaton():
    r = random.Random(2)
    for _ in range(400):
        text, value = ("".join(r.choice("ab" if r.random() < 0.5 else "abcİß") for _ in range(r.randint(0, 30))) for _ in range(2))
        start, size = Runs(value).longest(text)
        want = brute_run(text, value)
        assert size == want[1] and (not size or start == want[0])


def test_lowered_places():
    low, places = lowered("aİbSSß")
    assert low == "ai̇bssß" and list(places) == [0, 1, 1, 2, 3, 4, 5]
    assert lowered("Plain") == ("plain", None)


def test_recovered_against_brute_force(spark):
    r = random.Random(5)
    letters = "abABİßΣσ  é"
    pairs = [("WORLD", "İİİ say hello World today"), ("hello  world", "İ Hello World"), (" ß STRASSE", "eine ß strasse"), ("x", ""), ("", "x"), ("gone", None), ("Ünïcode", "so ünïCODE it is")]
    for _ in range(300):
        text = "".join(r.choice(letters) for _ in range(r.randint(1, 40)))
        a = r.randrange(len(text))
        span = list(text[a : a + r.randint(1, 14)].swapcase())
        if span and r.random() < 0.5:
            span[r.randrange(len(span))] = "q"
        pairs.append(("".join(span), text))
    spans = spark.createDataFrame([(f"t{i}", 0, s) for i, (s, _) in enumerate(pairs)], "task_id string, row_index int, span string")
    rows = spark.createDataFrame([(f"t{i}", 0, t) for i, (_, t) in enumerate(pairs)], "task_id string, row_index int, input string")
    got = {x["task_id"]: x["fixed"] for x in recovered(spans, rows).collect()}
    for i, (span, text) in enumerate(pairs):
        assert got[f"t{i}"] == brute(span, text), (span, text)


def test_long_span_in_long_text():
    r = random.Random(3)
    text = "".join(r.choice("abcdefgh ") for _ in range(108_000))
    value = text[50_000:50_450] + "".join(r.choice("xyz") for _ in range(150))
    start = time.time()
    assert Runs(value).longest(text) == (50_000, 450)
    assert time.time() - start < 1.0


@pytest.mark.parametrize(("text", "needle", "want"), [("İİİ say hello World today", "WORLD", "…hello World today"), ("one (two) three", "(TWO)", "one (two) three"), ("İ \\E x", "\\e X", "İ \\E x"), ("abc", "zzz", "abc")])
def test_snippet_behind_longer_lower_case(spark, text, needle, want):
    frame = spark.createDataFrame([(text, needle)], "t string, n string")
    assert frame.select(snippet(frame["t"], frame["n"], 6).alias("s")).first()["s"] == want


def test_few_runs_need_no_automaton(monkeypatch):
    """Searches and automaton find the same; a span as texts hold them is found without an automaton."""
    r = random.Random(7)
    for _ in range(2000):
        text, value = ("".join(r.choice("ab" if r.random() < 0.5 else "abcİ") for _ in range(r.randint(0, 25))) for _ in range(2))
        least = r.randint(1, 6)
        size, start = max(((n, -i) for i, n in [brute_run(text, value)]), default=(0, 0))
        want = (-start, size) if size >= least else (0, 0)
        assert runs.longest_run(value, text, least) == want
        monkeypatch.setattr(runs, "FEW_RUNS", r.choice([0, 64]))
    monkeypatch.setattr(runs, "FEW_RUNS", 64)
    monkeypatch.setattr(runs, "Runs", None)
    assert runs.meant("Recovered pieceX", "a recovered piece of text", "a recovered piece of text", None) == "recovered piece"
    assert runs.meant("[redacted]", "a recovered piece of text", "a recovered piece of text", None) is None


def test_each_span_goes_to_python_once(spark):
    """One evaluation, though what it gives is filtered, and one join with the rows."""
    from spanloom.operators.repair import autocleaned

    spans = spark.createDataFrame([("t", 0, "entities", "a", 0, "WordX"), ("t", 0, "entities", "b", 1, "none such"), ("t", 1, "entities", "b", 0, "Word")], "task_id string, row_index int, field string, type string, pos int, span string")
    rows = spark.createDataFrame([("t", 0, "one word."), ("u", 0, "x")], "task_id string, row_index int, input string")
    got = autocleaned(spans, rows)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("Join") == 1
    assert {tuple(r) for r in got.select("row_index", "type", "span").collect()} == {(0, "a", "word"), (1, "b", "Word")}
