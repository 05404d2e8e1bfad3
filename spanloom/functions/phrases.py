"""Phrases in texts by Aho-Corasick automata, a block of phrases at a time: one scan of the texts for each block, none of them shuffled."""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.graph import written

#: Characters of phrases that an automaton holds: some 200 MB in a Python worker.
BLOCK_CHARACTERS = 4 << 20
#: Phrases of these characters are found as whole words only, others anywhere.
WHOLE_WORDS = r"^[A-Za-z0-9 .\-_']*$"

#: The automaton of the block that this worker reads for, by name.
BUILT: dict[str, tuple] = {}


@lru_cache(maxsize=4096)
def is_word(c: str) -> bool:
    """Letters, marks, digits, connectors and joiners, as in \\w of Unicode."""
    return c.isascii() and (c.isalnum() or c == "_") or c in "‌‍" or unicodedata.category(c) in ("Lu", "Ll", "Lt", "Lm", "Lo", "Nl", "Nd", "Mn", "Mc", "Me", "Pc")


def blocks(phrases: DataFrame, characters: int) -> Iterator[list[tuple[str, str, bool]]]:
    """Rows (phrase, note, whole), as many at a time as hold that many characters, or one."""
    block, held = [], 0
    for r in phrases.toLocalIterator():
        if block and held + len(r.phrase) > characters:
            yield block
            block, held = [], 0
        block.append((r.phrase, r.note, r.whole))
        held += len(r.phrase)
    if block:
        yield block


def automaton(name: str, block: list[tuple[str, str, bool]]):
    """The block's automaton; a worker keeps the one it last needed. A phrase may stand for several rows."""
    import ahocorasick

    if name not in BUILT:
        rows: dict[str, list[int]] = {}
        for k, (phrase, _, _) in enumerate(block):
            rows.setdefault(phrase, []).append(k)
        found = ahocorasick.Automaton()
        for phrase, own in rows.items():
            found.add_word(phrase, (len(phrase), block[own[0]][2], own))
        found.make_automaton()
        BUILT.clear()
        BUILT[name] = (found,)
    return BUILT[name][0]


def held_phrases(found, text: str) -> list[int]:
    """Rows of the phrases that the text holds, each once."""
    seen: dict[int, None] = {}
    last = len(text) - 1
    for end, (size, whole, own) in found.iter(text):
        if own[0] in seen:
            continue
        start = end - size + 1
        if whole and (start > 0 and is_word(text[start - 1]) or end < last and is_word(text[end + 1])):
            continue
        seen.update(dict.fromkeys(own))
    return list(seen)


def phrases_in_text(rows: DataFrame, phrases: DataFrame, text: Column, keep: list[str], note: str = "note", characters: int = BLOCK_CHARACTERS, *, most: int | None = None) -> DataFrame:
    """keep, phrase and note: each row of rows with each phrase (phrase, note) that its text, in lower case, holds: whole words of ASCII letters, digits and
    blanks . - _ ' as whole words, other phrases anywhere. Phrases are in lower case.

    Works on a stream as on a table. Phrases come to the driver a block at a time and go on to the executors; each block is another scan
    of the rows, and what a task holds is bounded by the block. Null and empty texts and phrases hold and are nothing.

    With most, neighbouring rows of equal keep give one row for each phrase, with n_rows, how many of them hold it, and of these rows only the
    `most` longest phrases (ties: the smaller ones). What is among that many of all rows of a keep is so among any part of them: sums by keep and
    phrase are whole for the `most` longest of each keep, and for no others.
    """
    known = phrases.where(F.length("phrase") > 0).select("phrase", F.col("note").cast("string").alias("note"), F.col("phrase").rlike(WHOLE_WORDS).alias("whole"))
    texts = rows.select(*keep, F.lower(text).alias("low")).where(F.length("low") > 0)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields[:-1]) + f", phrase string, `{note}` string" + ("" if most is None else ", n_rows long")
    out = None
    for block in blocks(written(known), characters):  # all tasks work out the phrases, which are then read one partition after the other
        if most is not None:
            block.sort(key=lambda r: (-len(r[0]), r[0], r[1] or ""))
        shared, name = rows.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            held = shared.value
            found = automaton(name, held)
            named, notes = (pa.array([r[k] for r in held], pa.string()) for k in (0, 1))
            for batch in batches:
                at, which, counts = [], [], []
                lows = batch.column(len(keep)).to_pylist()
                if most is None:
                    for i, low in enumerate(lows):
                        own = held_phrases(found, low)
                        at += [i] * len(own)
                        which += own
                else:
                    keys = list(zip(*(batch.column(k).to_pylist() for k in range(len(keep))), strict=True))
                    for _, same in groupby(range(len(lows)), keys.__getitem__):
                        n: dict[int, int] = {}
                        for i in same:
                            for k in held_phrases(found, lows[i]):
                                n[k] = n.get(k, 0) + 1
                        own = sorted(n)[:most]  # phrases stand in that order in their block
                        at += [i] * len(own)
                        which += own
                        counts += [n[k] for k in own]
                if at:
                    index, phrase = pa.array(at), pa.array(which)
                    more = {} if most is None else {"n_rows": pa.array(counts, pa.int64())}
                    columns = {c: batch.column(k).take(index) for k, c in enumerate(keep)} | {"phrase": named.take(phrase), note: notes.take(phrase)} | more
                    yield pa.RecordBatch.from_pydict(columns)

        part = texts.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return texts.select(*keep, F.lit("").alias("phrase"), F.lit("").alias(note), *([] if most is None else [F.lit(0).cast("long").alias("n_rows")])).where(F.lit(False)) if out is None else out
