"""Text expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sentence punctuation at the end of a span.
TRAILING = r"[.,;:!?。，；：！？]+$"
#: Unicode white space and punctuation or quotes at either end.
EDGES = r"^[\s\p{Punct}“”‘’«»]+|[\s\p{Punct}“”‘’«»]+$"
#: A run of letters and digits outside the scripts that are written without blanks, or one character of such a script.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"
TOKEN = rf"{UNSPACED}|[^\s{UNSPACED[1:]}++"


def stripped(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def blank(text: Column) -> Column:
    return text.isNull() | (stripped(text) == "")


def without_trailing(span: Column) -> Column:
    return stripped(F.regexp_replace(span, TRAILING, ""))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)\S+")), F.lit(0))


def first_tokens(text: Column, n: int) -> Column:
    """The text up to the end of its n-th token, with its own spacing; a text of fewer tokens stays as it is."""
    found = F.regexp_extract(text, rf"(?U)^(?>\s*+(?:{TOKEN})){{{n}}}", 0)
    return F.when(found == "", text).otherwise(found)


def without_thoughts(text: Column) -> Column:
    """Model output without <think> parts and code fences."""
    bare = F.regexp_replace(text, r"(?is)<think>.*?</think>", "")
    return stripped(F.regexp_replace(bare, r"(?m)^\s*```[A-Za-z0-9]*\s*$", ""))


def tokens(text: Column) -> Column:
    """The TOKENs of a text in lower case; cutting at blanks takes less than half as long as looking for each token."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(text), UNSPACED, " $0 "), r"\s+"), "")


def shingles(text: Column, n: int) -> Column:
    """Distinct word n-grams in lower case; a shorter text is one shingle, a blank one has none."""

    def of(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).when(F.size(w) < n, F.array(F.array_join(w, " "))).otherwise(F.array_distinct(runs))

    return F.element_at(F.transform(F.array(tokens(text)), of), 1)  # the tokens are computed once


def snippet(text: Column, needle: Column, reach: int = 80) -> Column:
    """reach characters on both sides of the needle's first place, whatever the case, with … where text is cut; the head of the text
    if the needle isn't there."""
    low = F.lower(text)
    literal = F.concat(F.lit(r"(?iu)\Q"), F.replace(needle, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    # lower case makes some characters two, which moves the places behind them
    at = F.when(needle == "", 0).when(F.length(low) == F.length(text), F.instr(low, F.lower(needle))).otherwise(F.regexp_instr(text, literal))
    start, stop = F.greatest(at - reach, F.lit(1)), F.least(at + F.length(needle) + reach - 1, F.length(text))
    cut = F.concat(F.when(start > 1, "…").otherwise(""), text.substr(start, stop - start + 1), F.when(stop < F.length(text), "…").otherwise(""))
    head = F.concat(text.substr(1, 2 * reach), F.when(F.length(text) > 2 * reach, "…").otherwise(""))
    return F.when(at > 0, cut).otherwise(head)


def padded(number: Column, width: int) -> Column:
    """The digits of a number, filled with zeros to the width; longer ones stay whole, where lpad alone would cut them."""
    digits = number.cast("string")
    return F.lpad(digits, F.greatest(F.lit(width), F.length(digits)), F.lit("0"))
