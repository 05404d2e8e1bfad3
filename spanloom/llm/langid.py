"""Language identification by Bayesian evidence fusion.

Four kinds of evidence give the posterior of a row's language: the likelihood of its text, from hashed byte trigrams; the language its
markup declares; the suffix of its address; and a prior of its host, smoothed towards that of its domain and that towards the whole.
Text models come from a bounded sample of labelled rows; where those are among the rows to judge, each row is judged by a model of the
other half of them. A text that equally likely trigrams make far likelier than any language does is foreign and stays undetermined. The
other three kinds of evidence are learned without labels: rows add their text-only posteriors, by grouped aggregation, to the counts of
their host, domain, declared language and suffix; a row's own share is taken out again before it is judged.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import hashed_sample, materialise, row_ids, scratch, text_chunks, text_of

LANGUAGES = ("en", "de", "fr", "es")
BUCKETS = 1 << 14
#: Labelled rows of each language that the text model takes, about, chosen by a hash of the id.
TRAIN_ROWS = 2_000
#: Trigrams that a text's likelihood counts as at most, since neighbours aren't independent.
TRIGRAMS = 60
#: Rows' worth of the level above in a host's or domain's prior.
STRENGTH = 10.0
UNDETERMINED = "und"
#: How much likelier equally likely trigrams must make a text than any language does, as a logarithm, before it counts as foreign. On clean
#: texts of the test tables the most is 20; other scripts and far languages reach 180 and more, near ones, such as Italian, aren't told apart.
FOREIGN = 60.0
#: Groups whose sums may be broadcast, of about 60 bytes each; more go through a join, in which no key takes more than one part in PARTS of
#: all rows at once.
BROADCAST_GROUPS, PARTS = 100_000, 1_000

#: A host that is an address in numbers: it has no suffix.
NUMBERS = r"^[0-9.]+$|^\[|^[0-9a-f]*:"
MARKUP = re.compile(rb"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>")
DECLARED = re.compile(rb"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]+)")


def visible_text(page: bytes) -> bytes:
    """The text of a page without scripts, styles, comments and tags, entities decoded."""
    text = MARKUP.sub(b" ", page)
    return html.unescape(text.decode("utf-8", "replace")).encode() if b"&" in text else text


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of all texts, lower case, white space and digits as one kind of gap; and how many each text has."""
    clean = [b" " + b" ".join(t.lower().translate(None, b"0123456789.,;:!?()[]{}\"'*%#$&|=+<>/\\_~^@-").split()) + b" " for t in texts]
    counts = np.array([len(c) - 2 if len(c) > 2 else 0 for c in clean], np.int64)
    flat = np.frombuffer(b"".join(c for c, n in zip(clean, counts, strict=True) if n), np.uint8).astype(np.uint32)
    if len(flat) < 3:
        return np.zeros(0, np.int64), counts
    hashed = (flat[:-2] << 16 | flat[1:-1] << 8 | flat[2:]) * np.uint32(2654435761) >> np.uint32(18)
    ends = np.cumsum(counts[counts > 0] + 2)
    keep = np.ones(len(hashed) + 2, bool)
    keep[ends - 1] = keep[ends - 2] = False
    return hashed[keep[:-2]].astype(np.int64), counts


def text_model(rows: DataFrame, languages: tuple[str, ...]) -> np.ndarray:
    """log P(trigram | language), languages x buckets, from rows (id, lang, text)."""
    chosen = hashed_sample(rows.where(F.col("lang").isin(*languages)), "id", "lang", TRAIN_ROWS, 7)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), BUCKETS), np.int64)
        for batch, texts in text_chunks(batches, "text"):
            own = np.array([languages.index(x) for x in batch.column(0).to_pylist()], np.int64)
            buckets, n = trigrams(texts)
            counts += np.bincount(np.repeat(own, n) * BUCKETS + buckets, minlength=counts.size).reshape(counts.shape)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts.ravel()[at])], names=["at", "n"])

    found = chosen.select("lang", "text").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.full(len(languages) * BUCKETS, 0.5)
    counts[found.column("at").to_numpy()] += found.column("n").to_numpy()
    counts = counts.reshape(len(languages), BUCKETS)
    return np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def text_evidence(rows: DataFrame, models: list[np.ndarray], markup: bool) -> DataFrame:
    """uid and all columns of rows but text and fold, with declared (from the markup, if there is one), n_trigrams, likelihood array<double>: of
    each language, 1 for the likeliest, and foreign. fold says which of the models judges a row."""
    shared = rows.sparkSession.sparkContext.broadcast([m.T.copy() for m in models])
    own = [f for f in rows.schema.fields if f.name not in ("text", "declared", "fold")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, state = shared.value, {}
        for batch, texts in text_chunks(batches, "text"):
            declared = batch.column(batch.schema.get_field_index("declared"))
            if markup:
                found = [DECLARED.search(t) for t in texts]
                declared = pa.array([m[1].decode() if m else None for m in found], pa.string())
                texts = [visible_text(t) for t in texts]
            buckets, n = trigrams(texts)
            sums, fold = np.zeros((len(texts), tables[0].shape[1])), batch.column(batch.schema.get_field_index("fold")).to_numpy()
            for i, table in enumerate(tables):
                mine = (n > 0) & (fold == i)
                if mine.any():
                    part = np.repeat(mine, n)
                    sums[mine] = np.add.reduceat(table[buckets[part]], (np.cumsum(n[mine]) - n[mine]), axis=0, dtype=np.float64)
            counted = np.minimum(n, TRIGRAMS)
            sums *= (counted / np.maximum(n, 1))[:, None]
            foreign = (n > 0) & (-counted * np.log(BUCKETS) - sums.max(axis=1) > FOREIGN)
            likelihood = np.exp(sums - sums.max(axis=1, keepdims=True))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(likelihood.ravel()), table.shape[1]).cast(pa.list_(pa.float64()))
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in own]
            yield pa.RecordBatch.from_arrays([pa.array(row_ids(len(texts), state)), *columns, declared, pa.array(n), lists, pa.array(foreign)], names=["uid", *(f.name for f in own), "declared", "n_trigrams", "likelihood", "foreign"])

    schema = "uid long, " + "".join(f"{f.name} {f.dataType.simpleString()}, " for f in own) + "declared string, n_trigrams long, likelihood array<double>, foreign boolean"
    return rows.mapInArrow(run, schema)


def normal(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.transform(values, lambda x: x / total)


def with_sums(rows: DataFrame, key: str, k: int, groups: int = BROADCAST_GROUPS, parts: int = PARTS) -> DataFrame:
    """rows with {key}_sum array<double>: the sum of the text posteriors p of all rows of the key.

    Up to that many groups the sums are broadcast, after a count. More are joined, and a key of n rows is split into ceil(n * parts / all
    rows) shares, each with its own copy of the sum; fewer than `parts` keys are split at all, so those are broadcast to split the rows.
    """
    added = rows.groupBy(key).agg(F.count("*").alias("n"), *(F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(k)))
    added = materialise(added.select(key, "n", F.array(*(f"s{i}" for i in range(k))).alias(f"{key}_sum")))
    found, total = added.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if found <= groups:
        return rows.join(F.broadcast(added.drop("n")), key)  # the count bounds it
    shares = F.ceil(F.col("n") * parts / F.lit(total)).cast("int")
    hot = added.where(shares > 1).select(key, shares.alias("_shares"))
    own = rows.join(F.broadcast(hot), key, "left").withColumn("_share", F.pmod("uid", F.coalesce("_shares", F.lit(1)).cast("long")).cast("int")).drop("_shares")
    copies = added.select(key, f"{key}_sum", F.explode(F.sequence(F.lit(0), shares - 1)).alias("_share"))
    return own.join(copies.hint("shuffle_merge"), [key, "_share"]).drop("_share")


def fused(rows: DataFrame, languages: tuple[str, ...], least_confidence: float, **limits: int) -> DataFrame:
    """Judges rows (uid, declared, host, domain, suffix, n_trigrams, likelihood, foreign, ...): adds language, text_language, confidence and
    accepted."""
    k = len(languages)
    rows = rows.withColumn("p", normal(F.col("likelihood")))
    seen = (F.col("n_trigrams") > 0) & ~F.col("foreign")
    rows = rows.withColumn("p", F.when(seen, F.col("p")).otherwise(F.array(*[F.lit(0.0)] * k)))  # no text, no vote
    whole = rows.agg(*(F.coalesce(F.sum(F.col("p")[i]), F.lit(0.0)) for i in range(k))).first()
    base = np.array([w + 1.0 for w in whole])
    base = F.array(*(F.lit(float(b)) for b in base / base.sum()))
    for key in ("host", "domain", "declared", "suffix"):
        rows = with_sums(rows, key, k, **limits)
    total = F.array(*(F.lit(float(w)) for w in whole))

    def without(counts: Column) -> Column:
        return F.zip_with(counts, "p", lambda c, p: F.greatest(c - p, F.lit(0.0)))

    def smoothed(counts: Column, above: Column) -> Column:
        weight = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x) + STRENGTH
        return F.transform(F.arrays_zip(counts.alias("c"), above.alias("a")), lambda x: (x.c + x.a * STRENGTH) / weight)

    def given(counts: Column) -> Column:
        """P(value | language) up to a factor: the value's share of each language's rows."""
        return F.transform(F.arrays_zip(counts.alias("c"), without(total).alias("t"), base.alias("b")), lambda x: (x.c + STRENGTH * x.b) / (x.t + STRENGTH))

    rows = rows.withColumn("prior", smoothed(without(F.col("domain_sum")), base))
    rows = rows.withColumn("prior", smoothed(without(F.col("host_sum")), F.col("prior")))
    rows = rows.withColumn("said", F.when(F.col("declared") == "", F.array(*[F.lit(1.0)] * k)).otherwise(given(without(F.col("declared_sum")))))
    rows = rows.withColumn("ending", F.when(F.col("suffix") == "", F.array(*[F.lit(1.0)] * k)).otherwise(given(without(F.col("suffix_sum")))))
    posterior = normal(F.transform(F.arrays_zip("likelihood", "prior", "said", "ending"), lambda x: x.likelihood * x.prior * x.said * x.ending))
    rows = rows.withColumn("posterior", posterior).withColumn("confidence", F.array_max("posterior"))
    name = lambda values: F.element_at(F.array(*(F.lit(x) for x in languages)), F.array_position(values, F.array_max(values)).cast("int"))
    return rows.withColumn("language", F.when(seen, name(F.col("posterior"))).otherwise(UNDETERMINED)).withColumn("text_language", F.when(seen, name(F.col("likelihood"))).otherwise(UNDETERMINED)).withColumn("accepted", seen & (F.col("confidence") >= least_confidence))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def domain_of(host: Column) -> Column:
    """The last two labels, or three where the country's second level is a common registry's; of an address in numbers, the whole."""
    return F.when(host.rlike(NUMBERS), host).otherwise(F.regexp_extract(host, r"(?:[^.]*\.)?(?:(?:co|com|org|net|gov|edu|ac)\.[a-z]{2}|[^.]*)$", 0))


def suffix_of(host: Column) -> Column:
    return F.when(host.rlike(NUMBERS), "").otherwise(F.regexp_extract(host, r"[^.]*$", 0))


def labelled(rows: DataFrame, id_col: str, lang_col: str, text_col: str) -> DataFrame:
    return rows.select(F.col(id_col).alias("id"), F.lower(F.col(lang_col)).alias("lang"), text_of(text_col).alias("text"))


@scratch
def page_languages(pages: DataFrame, known: DataFrame, languages: tuple[str, ...] = LANGUAGES, least_confidence: float = 0.5, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: its id, language, text_language (of the text alone), declared, confidence and accepted.

    known: labelled texts (doc_id, lang, text). Nulls: a null or empty page, one without letters, or one in a foreign language is 'und',
    with the confidence of its other evidence, and not accepted; a null address has host and suffix '', as an address in numbers has no
    suffix; a page that declares nothing has declared ''. Equal posteriors go to the language named first. Repeated rows count again. An
    empty table gives an empty result; other columns aren't read. Pages are read whole, whatever their length.
    """
    model = text_model(labelled(known, "doc_id", "lang", "text"), languages)
    host = host_of(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), text_of(html_col).alias("text"), F.lit(None).cast("string").alias("declared"), F.lit(0).alias("fold"))
    rows = rows.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    evidence = materialise(text_evidence(rows, [model], markup=True).withColumn("declared", F.lower(F.coalesce("declared", F.lit("")))))
    return fused(evidence, languages, least_confidence).select(F.col("id").alias(id_col), "language", "text_language", "declared", F.round("confidence", 6).alias("confidence"), "accepted")


@scratch
def text_languages(docs: DataFrame, languages: tuple[str, ...] = LANGUAGES, least_confidence: float = 0.5, id_col: str = "doc_id", text_col: str = "text", declared_col: str = "lang", site_col: str = "source") -> DataFrame:
    """As page_languages(), for plain texts with a declared language and a site: id, text_hash, language, text_language, declared,
    confidence, accepted. The text models learn from the declared languages of a sample, one from each half of the ids; a row is judged by
    the one that hasn't seen its half, so that its own label counts once, as declared evidence."""
    fold = F.pmod(F.xxhash64(F.lit(23), F.col(id_col)), F.lit(2)).cast("int")
    models = [text_model(labelled(docs.where(fold != i), id_col, declared_col, text_col), languages) for i in range(2)]
    site = F.coalesce(F.col(site_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("text_hash"), site.alias("host"), F.lit("").alias("domain"), F.lit("").alias("suffix"), F.lower(F.coalesce(F.col(declared_col).cast("string"), F.lit(""))).alias("declared"), text_of(text_col).alias("text"), fold.alias("fold"))
    evidence = materialise(text_evidence(rows, models, markup=False))
    return fused(evidence, languages, least_confidence).select(F.col("id").alias(id_col), "text_hash", "language", "text_language", "declared", F.round("confidence", 6).alias("confidence"), "accepted")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs whose language text_languages() accepts, with all their columns. Null and empty texts, those without letters and foreign
    ones go; very long texts are judged whole. Repeated rows stay or go together: rows of equal id and text go if one of them isn't
    accepted; a null id is one id. An empty table gives an empty result."""
    out = materialise(text_languages(docs, id_col=id_col, text_col=text_col, **options).where(~F.col("accepted")).select(F.col(id_col).alias("out_id"), F.col("text_hash").alias("out_hash")).distinct())
    return docs.join(out, docs[id_col].eqNullSafe(out["out_id"]) & (F.xxhash64(text_of(text_col)) == out["out_hash"]), "left_anti")
