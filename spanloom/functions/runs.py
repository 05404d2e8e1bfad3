"""Pieces of a text that a span means although it is spelled otherwise: places whatever the case, and the longest common run."""

from __future__ import annotations

import re
from array import array

import pandas as pd


def lowered(text: str) -> tuple[str, array | None]:
    """The text in lower case, character by character, and the original place of each character; None where places stay as they are."""
    low = text.lower()
    if len(low) == len(text) and "Σ" not in text:
        return low, None
    parts = [c.lower() for c in text]
    return "".join(parts), array("q", [i for i, p in enumerate(parts) for _ in p])


def piece(text: str, places: array | None, start: int, size: int) -> str:
    """The characters of the text that the run of its lowered form covers."""
    return text[start : start + size] if places is None else text[places[start] : places[start + size - 1] + 1]


class Runs:
    """A suffix automaton: knows every run of characters of a value, in space in proportion to its length."""

    def __init__(self, value: str):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.size = [-1], [0]
        last = 0
        for c in value:
            new = self.state(self.size[last] + 1, {})
            at = last
            while at >= 0 and c not in self.next[at]:
                self.next[at][c] = new
                at = self.link[at]
            if at >= 0:
                old = self.next[at][c]
                if self.size[old] == self.size[at] + 1:
                    self.link[new] = old
                else:
                    twin = self.state(self.size[at] + 1, dict(self.next[old]))
                    self.link[twin], self.link[old], self.link[new] = self.link[old], twin, twin
                    while at >= 0 and self.next[at].get(c) == old:
                        self.next[at][c] = twin
                        at = self.link[at]
            else:
                self.link[new] = 0
            last = new

    def state(self, size: int, moves: dict[str, int]) -> int:
        self.next.append(moves)
        self.link.append(-1)
        self.size.append(size)
        return len(self.size) - 1

    def longest(self, text: str) -> tuple[int, int]:
        """Start and size of the longest run of the text that is one of the value; the first, if there are several. One pass over the text."""
        moves, link, size = self.next, self.link, self.size
        state = held = best = end = 0
        for i, c in enumerate(text):
            while state and c not in moves[state]:
                state = link[state]
                held = size[state]
            to = moves[state].get(c)
            if to is not None:
                state, held = to, held + 1
                if held > best:
                    best, end = held, i + 1
        return end - best, best


#: Runs of a value that are looked for one by one, at most; for more, an automaton reads the text.
FEW_RUNS = 64


def longest_run(value: str, text: str, least: int) -> tuple[int, int]:
    """Start and size of the longest run of the text, of at least that many characters, that is one of the value; the first, if there are
    several; (0, 0) if there is none. Most texts hold no run of the least size, which few searches show."""
    spare = len(value) - least
    if spare < 0:
        return 0, 0
    if (spare + 1) * (spare + 2) // 2 > FEW_RUNS:
        start, size = Runs(value).longest(text)
        return (start, size) if size >= least else (0, 0)
    if not any(value[i : i + least] in text for i in range(spare + 1)):
        return 0, 0
    for size in range(len(value), least - 1, -1):
        starts = [at for i in range(len(value) - size + 1) if (at := text.find(value[i : i + size])) >= 0]
        if starts:
            return min(starts), size
    return 0, 0


def meant(span: str, text: str, low: str, places: array | None, share: float = 0.7, least: int = 4) -> str | None:
    """The piece of the text that the span means, if any: see repair.recovered()."""
    for value in (span, span.strip(), re.sub(r"\s+", " ", span).strip()):
        if not value:
            continue
        if value in text:
            return value
        wanted, _ = lowered(value)
        at = low.find(wanted)
        if at >= 0:
            return piece(text, places, at, len(wanted))
    start, size = longest_run(lowered(span)[0], low, max(least, int(len(span) * share), 1))
    return piece(text, places, start, size) if size else None


def meant_pieces(spans: pd.Series, texts: pd.Series) -> pd.Series:
    """meant() for pairs; a pair without span or text has none. Neighbours with one text share its lowered form."""
    out, last, held = [], None, ("", None)
    for span, text in zip(spans, texts, strict=True):
        if not span or not text:
            out.append(None)
            continue
        if text is not last:
            if text != last:
                held = lowered(text)
            last = text
        out.append(meant(span, text, *held))
    return pd.Series(out, dtype="object")
