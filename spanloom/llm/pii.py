"""Format-preserving Feistel pseudonyms for personal data in texts. DataFrame functions only.

Values are found by one pattern, validated by kind, and permuted under a key within their format, so that equal values get equal
pseudonyms in all documents, whatever their separators, and who has the key can undo it. Each kind has its own permutation:

- card: 13 to 19 digits that pass the Luhn check. All but the last are permuted; the last is set so that the check passes.
- iban: account numbers of the countries listed whose check digits are right; country and layout stay, new check digits fit.
- ssn: area, group and serial as three, two and four digits with dashes, none of them one that is never issued.
- phone: 8 to 15 digits, with their layout kept; a number of ten digits is the same with and without a 1 before it. Other country codes are
  part of the number. - email: letters and digits of the local part; the domain stays.
- ip: four octets up to 255; zeros that fill an octet are lost.
- date: days from 1800 to 2199 as year-month-day, year/month/day, day.month.year, month/day/year, or, where only that is a date,
  day/month/year, also before a time; a valid date becomes a valid date of the same layout, but that a day/month/year becomes a
  day.month.year (and comes back as one) where its pseudonym's day is one of the first twelve.

What fails its kind's test stays as it is. The keystream is HMAC-SHA-512. The key reaches the executors as a literal of the plan, so
whoever can read the plan in the web UI or the event log can read it there: keep both as closed as the key, or switch them off.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

# The patterns of the kinds.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"  # possessive: Java would recurse once for each label
#: Account numbers: characters by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23,
    "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}
IBAN = r"(?<![A-Za-z0-9])(?:" + "|".join(rf"(?:{'|'.join(c for c, m in IBAN_LENGTHS.items() if m == n)})\d\d(?: ?[A-Z0-9]){{{n - 4}}}" for n in sorted(set(IBAN_LENGTHS.values()))) + r")(?![A-Za-z0-9])"
SSN = r"(?<![A-Za-z0-9-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![A-Za-z0-9-])"
#: After a blank, what starts a card, date or address doesn't go on with a phone.
OTHER = r"(?!\d{4}[ -]\d{4}[ -]\d{4}[ -]|\d{4}[ -]\d{6}[ -]\d{4}|\d{13}|\d{4}[-/]\d{1,2}[-/]\d|\d{1,2}[./]\d{1,2}[./]\d{4}|\d{1,3}(?:\.\d{1,3}){3})"
MORE = rf"(?:[./-]?\d| {OTHER}\d)"
#: Without +: an area code in brackets, groups of 3, 3 and 4 (unless a card of one layout starts there), and a leading 0, which is kept.
TRUNK = r"0\d{1,4}[ /-]\d{5,9}"
LOCAL = rf"\(\d{{2,5}}\)[ .-]?\d{{3,4}}[ .-]?\d{{3,4}}|(?!\d(?:(?:-?\d){{12,18}}|(?: ?\d){{12,18}})(?![A-Za-z0-9]))(?:\d{{1,2}}[ .-])?\d{{3}}[ .-]\d{{3}}[ .-]\d{{4}}|{TRUNK}"
PHONE = (
    r"(?<![A-Za-z0-9])\+?\d{1,3}[ .-]?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}(?![A-Za-z0-9])|\+\d{1,3}(?:[ .-]\d{2,4}){3,4}(?![A-Za-z0-9])"
    rf"|\+\d{MORE}{{7,14}}(?![A-Za-z0-9])|\+\d{{1,3}}[ .-]?\(\d{{1,5}}\)[ .-]?\d{MORE}{{3,8}}(?![A-Za-z0-9])|(?<![A-Za-z0-9+./-])(?:{LOCAL})(?![A-Za-z0-9])"
)
ONE_DATE = r"\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4}|\d{4}/\d{1,2}/\d{1,2}"
DATE = rf"(?<![A-Za-z0-9./-])(?:{ONE_DATE})(?:(?=T\d\d:?\d\d)|(?![A-Za-z0-9/-]))"
ADDRESS = r"(?<![A-Za-z0-9.])\d{1,3}(?:\.\d{1,3}){3}(?![A-Za-z0-9])(?!\.\d)"
CARD = r"(?<![A-Za-z0-9])\d(?:[ -]?\d){12,18}(?![A-Za-z0-9])"
ANY = "|".join((EMAIL, IBAN, SSN, PHONE, DATE, ADDRESS, CARD))

#: Days of 400 years, which is a whole number of calendar cycles; the two factors are the halves of the network for dates.
FIRST_DAY, DAYS = "1800-01-01", (189, 773)
#: Social security numbers: areas (1 to 899 without 666), and groups times serials.
AREAS, SERIALS = 898, 9_999


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def steps(undo: bool) -> Column:
    """Two steps for each round: the keystream, then the change of one half."""
    return F.array(*(F.lit(s) for r in (reversed(range(ROUNDS)) if undo else range(ROUNDS)) for s in (2 * r, 2 * r + 1)))


def stream(key: str, kind: str, step: Column, half: Column) -> Column:
    """HMAC-SHA-512 of kind, step and half, as 128 hex digits."""
    block = (key.encode() if len(key.encode()) <= 128 else hashlib.sha512(key.encode()).digest()).ljust(128, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    message = F.concat_ws("|", F.lit(kind), step.cast("string"), half.cast("string")).cast("binary")
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 512))), 512)


def shifted(chars: Column, stream: Column, sign: int) -> Column:
    """Each digit and ASCII letter moved within its class by the keystream; other characters as they are."""

    def one(c: Column, i: Column) -> Column:
        by = F.conv(stream.substr(F.pmod(i * 4, F.lit(128)) + 1, F.lit(4)), 16, 10).cast("int") * sign
        turn = lambda first, n: F.char(F.lit(first) + F.pmod(F.ascii(c) - first + by, F.lit(n)))
        return F.when(c.between("0", "9"), turn(48, 10)).when(c.between("A", "Z"), turn(65, 26)).when(c.between("a", "z"), turn(97, 26)).otherwise(c)

    return F.array_join(F.transform(F.split(chars, ""), one), "")


def permuted_text(value: Column, kind: str, key: str, undo: bool) -> Column:
    """A keyed permutation of the strings with the same length and the same class of character at each place."""
    half = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(value.substr(F.lit(1), half).alias("l"), value.substr(half + 1, F.length(value)).alias("r"), F.lit("").alias("k"))

    def one(s: Column, step: Column) -> Column:
        left = F.shiftright(step, 1) % 2 == 0
        change = F.when(left, F.struct(shifted(s.l, s.k, -1 if undo else 1).alias("l"), s.r.alias("r"), s.k.alias("k"))).otherwise(F.struct(s.l.alias("l"), shifted(s.r, s.k, -1 if undo else 1).alias("r"), s.k.alias("k")))
        return F.when(step % 2 == 0, F.struct(s.l.alias("l"), s.r.alias("r"), stream(key, kind, F.shiftright(step, 1), F.when(left, s.r).otherwise(s.l)).alias("k"))).otherwise(change)

    return F.aggregate(steps(undo), start, one, lambda s: F.concat(s.l, s.r))


def permuted_pair(left: Column, right: Column, sizes: tuple[int, int], kind: str, key: str, undo: bool) -> Column:
    """struct(l, r): a keyed permutation of the pairs of numbers below the two sizes."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def one(s: Column, step: Column) -> Column:
        by = lambda half: F.conv(stream(key, kind, step, half).substr(F.lit(1), F.lit(12)), 16, 10).cast("long") * (-1 if undo else 1)
        return F.when(step % 2 == 0, F.struct(F.pmod(s.l + by(s.r), F.lit(sizes[0])).alias("l"), s.r.alias("r"))).otherwise(F.struct(s.l.alias("l"), F.pmod(s.r + by(s.l), F.lit(sizes[1])).alias("r")))

    return F.aggregate(F.array(*(F.lit(r) for r in (reversed(range(ROUNDS)) if undo else range(ROUNDS)))), start, one)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def refilled(value: Column, chars: Column, kept: str = "[^0-9]") -> Column:
    """value with its characters replaced, in order, by chars, but for those of the class kept."""

    def one(c: Column, i: Column) -> Column:
        return F.when(c.rlike(kept), c).otherwise(chars.substr(F.length(F.regexp_replace(value.substr(F.lit(1), i + 1), kept, "")), F.lit(1)))

    return F.array_join(F.transform(F.split(value, ""), one), "")


def card(value: Column, key: str, undo: bool) -> Column:
    body = permuted_text(digits(value).substr(F.lit(1), F.length(digits(value)) - 1), "card", key, undo)
    full = let(body, lambda b: F.concat(b, F.element_at(F.filter(F.array(*(F.lit(str(d)) for d in range(10))), lambda d: F.call_function("luhn_check", F.concat(b, d))), 1)))
    return F.when(F.call_function("luhn_check", digits(value)), let(full, lambda f: refilled(value, f)))


def check_digits(country: Column, account: Column) -> Column:
    """The two digits that make country, digits and account a valid number: letters count from 10 on, the whole modulo 97 must be 1."""
    add = lambda a, c: F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97).cast("int")
    rest = F.aggregate(F.split(F.concat(account, country, F.lit("00")), ""), F.lit(0), add)
    return F.lpad((98 - rest).cast("string"), 2, "0")


def iban(value: Column, key: str, undo: bool) -> Column:
    plain = F.replace(value, F.lit(" "), F.lit(""))
    country, given, account = plain.substr(1, 2), plain.substr(3, 2), plain.substr(F.lit(5), F.length(plain))
    new = let(permuted_text(account, "iban", key, undo), lambda a: F.concat(country, check_digits(country, a), a))
    return F.when(given == check_digits(country, account), let(new, lambda n: refilled(value, n, " ")))


def ssn(value: Column, key: str, undo: bool) -> Column:
    area, group, serial = (F.split(value, "-")[i].cast("int") for i in range(3))
    pair = permuted_pair(F.when(area > 666, area - 2).otherwise(area - 1), (group - 1) * SERIALS + serial - 1, (AREAS, 99 * SERIALS), "ssn", key, undo)
    fill = lambda n, width: F.lpad(n.cast("string"), width, "0")
    return let(pair, lambda p: F.concat_ws("-", fill(F.when(p.l >= 665, p.l + 2).otherwise(p.l + 1), 3), fill(F.floor(p.r / SERIALS) + 1, 2), fill(p.r % SERIALS + 1, 4)))


def phone(value: Column, key: str, undo: bool) -> Column:
    """A leading 0 of a national layout stays, and so does the 1 before a number of ten digits, which is linked with that number alone; other numbers of
    eleven digits keep away from those that begin with 1."""
    every = digits(value)
    n, trunk = F.length(every), value.rlike(f"^(?:{TRUNK})$")
    kept = F.when(trunk | ((n == 11) & every.startswith("1")), 1).otherwise(0)
    body = permuted_text(every.substr(kept + 1, n), "phone", key, undo)
    first = every.substr(1, 1).cast("long")
    pair = permuted_pair(F.when(first > 1, first - 1).otherwise(first), every.substr(2, 10).cast("long"), (9, 10**10), "phone", key, undo)
    other = let(pair, lambda p: F.concat(F.when(p.l > 0, p.l + 1).otherwise(p.l).cast("string"), F.lpad(p.r.cast("string"), 10, "0")))
    new = F.when((n == 11) & (kept == 0), other).otherwise(F.concat(every.substr(F.lit(1), kept), body))
    return F.when(n.between(8, 15), let(new, lambda p: refilled(value, p)))


def address(value: Column, key: str, undo: bool) -> Column:
    octets = F.transform(F.split(value, r"\."), lambda o: o.cast("int"))
    pair = permuted_pair(octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], (65536, 65536), "ip", key, undo)
    dotted = let(pair, lambda p: F.concat_ws(".", *(x.cast("string") for x in (F.shiftright(p.l, 8), p.l % 256, F.shiftright(p.r, 8), p.r % 256))))
    return F.when(F.forall(octets, lambda o: o <= 255), dotted)


def email(value: Column, key: str, undo: bool) -> Column:
    at = F.instr(value, "@")
    return F.concat(permuted_text(value.substr(F.lit(1), at - 1), "email", key, undo), value.substr(at, F.length(value)))


def date(value: Column, key: str, undo: bool) -> Column:
    """Layouts: year first, or by separator: . day first, / month first, or day first where that alone is a date. Parts are filled with
    zeros to their former widths. One day has one pseudonym in all layouts; where that of a day/month/year would read as month/day/year,
    it is written with dots."""
    first = F.lit(FIRST_DAY).cast("date")
    parts = F.split(value, r"[./-]")
    late = value.rlike(r"^\d{1,2}/") & parts[0].cast("int").between(13, 31)
    order = F.when(value.rlike(r"^\d{4}"), F.array(F.lit(0), F.lit(1), F.lit(2))).when(value.contains(".") | late, F.array(F.lit(2), F.lit(1), F.lit(0))).otherwise(F.array(F.lit(2), F.lit(0), F.lit(1)))
    get = lambda i: F.get(parts, F.get(order, F.lit(i)))
    day = F.concat_ws("-", get(0), F.lpad(get(1), 2, "0"), F.lpad(get(2), 2, "0")).try_cast("date")
    number = F.date_diff(day, first).cast("long")
    pair = permuted_pair(F.floor(number / DAYS[1]), number % DAYS[1], DAYS, "date", key, undo)
    made = let(pair, lambda p: F.date_add(first, (p.l * DAYS[1] + p.r).cast("int")))

    def written(d: Column) -> Column:
        new = F.array(F.date_format(d, "yyyy"), F.date_format(d, "M"), F.date_format(d, "d"))
        fill = lambda i: F.lpad(F.get(new, F.array_position(order, i).cast("int") - 1), F.greatest(F.length(F.get(parts, F.lit(i))), F.length(F.get(new, F.array_position(order, i).cast("int") - 1))), F.lit("0"))
        mark = F.when(late & (F.dayofmonth(d) <= 12), ".").otherwise(F.regexp_extract(value, "[./-]", 0))
        return F.concat(fill(0), mark, fill(1), mark, fill(2))

    return F.when(number.between(0, DAYS[0] * DAYS[1] - 1), let(made, written))


def pseudonym(value: Column, key: str, undo: bool = False) -> Column:
    """The pseudonym of a value, or null if it fails its kind's test."""
    kinds = (
        F.when(value.contains("@"), email(value, key, undo))
        .when(value.rlike("^[A-Z]"), iban(value, key, undo))
        .when(value.rlike(r"^\d{3}-\d{2}-\d{4}$"), ssn(value, key, undo))
        .when(value.rlike(f"^(?:{ONE_DATE})$"), date(value, key, undo))
        .when(value.rlike(r"^\d+(\.\d+){3}$"), address(value, key, undo))
        .when(value.startswith("+") | value.contains("(") | value.rlike(f"^(?:{LOCAL})$"), phone(value, key, undo))
        .otherwise(card(value, key, undo))
    )
    return kinds


def pseudonymise(docs: DataFrame, key: str, undo: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id, the text with pseudonyms, and n_values, how many it holds. undo gives the values back.

    Nulls: a null id stays null, a null text stays null with 0 values. An empty text stays empty; very long texts are treated whole, also
    those that are one long mail-like or digit run. Equal values get equal pseudonyms wherever they stand. Repeated rows give repeated
    rows, an empty table an empty result; other columns aren't read.
    """
    text = F.col("text")
    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("found", F.when(text.rlike("[0-9@]"), F.transform(found, lambda m: F.struct(m.alias("old"), pseudonym(m, key, undo).alias("new")))))
    some = F.coalesce(F.size("found") > 0, F.lit(False))
    put = F.concat(F.transform("found", lambda m: F.coalesce(m.new, m.old)), F.array(F.lit("")))
    changed = F.array_join(F.zip_with(F.split(text, ANY, -1), put, lambda a, b: F.concat(a, b)), "")
    return rows.select(F.col("id").alias(id_col), F.when(some, changed).otherwise(text).alias("text"), F.when(some, F.size(F.filter("found", lambda m: m.new.isNotNull()))).otherwise(0).cast("long").alias("n_values"))
