"""The queries of this package and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import bpe, containment, hmm, langid, lines, media, neardup, negatives, neighbours, phrases, pii, sharding, toxicity
from spanloom.llm.common import materialise, scratch, table


def op1_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.language_model_scores(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("language")


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shuffle_into_shards(table(spark, sf_dir, "documents"))


def op4_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), key="replace this key")


def op5_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_spread_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.page_languages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


@scratch
def op10_png(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = materialise(media.store_images(table(spark, sf_dir, "documents")))
    return media.image_features(images, keep=("n_bytes",)).drop("width", "height")  # error stays: it is null but for a damaged image


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents")).drop("k")


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), negatives.whole(F.col("embedding")).alias("embedding"))
    return negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hmm": op1_hmm,
    "op2_toxicity": op2_toxicity,
    "op3_shards": op3_shards,
    "op4_feistel": op4_feistel,
    "op5_minmax": op5_minmax,
    "op6_lines": op6_lines,
    "op7_language": op7_language,
    "op8_decontamination": op8_decontamination,
    "op9_bpe": op9_bpe,
    "op10_png": op10_png,
    "op11_phrases": op11_phrases,
    "op12_nearest": op12_nearest,
    "op13_negatives": op13_negatives,
}

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = "regexp_extract_all(" + LOWER + r", '[^\x20\x09-\x0D]+')"


def shingles_sql(name: str, source: str, key: str) -> str:
    """CTEs {name}_words and {name} (key, shingle), the distinct five-word shingles of a table's texts."""
    return f"""{name}_words AS (SELECT {key}, {WORDS.format("text")} AS w FROM {source}),
{name} AS (SELECT DISTINCT {key}, array_to_string(w[i : i + 4], ' ') AS shingle
  FROM (SELECT {key}, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM {name}_words WHERE len(w) > 0))"""


OP5_SQL = f"""
WITH RECURSIVE {shingles_sql("doc", "documents", "doc_id")},
sizes AS (SELECT doc_id, count(*) AS n FROM doc GROUP BY doc_id),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM doc a JOIN doc b USING (shingle) JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least AS component_id, d.doc_id = least AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN (SELECT doc_id, min(other) AS least FROM reach GROUP BY doc_id) m ON m.doc_id = d.doc_id
"""

OP6_SQL = f"""
WITH lines AS (SELECT doc_id, source, i, l[i] AS line, trim(regexp_replace({LOWER.format("l[i]")}, '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS key
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
spread AS (SELECT key, min(doc_id) AS first FROM lines WHERE len(string_split(key, ' ')) >= 3 GROUP BY key HAVING count(DISTINCT source) >= 5)
SELECT doc_id, count(*) AS n_lines, count(s.key) FILTER (s.first <> doc_id) AS n_removed,
  coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (s.key IS NULL OR s.first = doc_id), '') AS text
FROM lines LEFT JOIN spread s USING (key) GROUP BY doc_id
"""

OP8_SQL = f"""
WITH {shingles_sql("item", "benchmark", "item_id")},
{shingles_sql("doc", "documents", "doc_id")},
sizes AS (SELECT item_id, count(*) AS n FROM item GROUP BY item_id)
SELECT doc_id, item_id, n AS n_item_shingles, count(*) AS n_shared, count(*) / n::DOUBLE AS containment
FROM doc JOIN item USING (shingle) JOIN sizes USING (item_id) GROUP BY doc_id, item_id, n HAVING count(*) >= 0.75 * n
"""

OP11_SQL = f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array({LOWER.format("text")}, '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS w FROM documents),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
total AS (SELECT lang, count(*) AS n FROM starts GROUP BY lang),
runs AS (SELECT lang, w, i, unnest(range(1, least(5, len(w) - i + 1) + 1)) AS m FROM starts),
counts AS (SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, m, count(*) AS a FROM runs GROUP BY lang, phrase, m HAVING count(*) >= 100),
words AS (SELECT lang, phrase, m, a, string_split(phrase, ' ') AS w FROM counts),
parts AS (SELECT lang, a, m AS whole, w, unnest(range(2, m)) AS m FROM words WHERE m > 2),
inner_parts AS (SELECT lang, a, w, m, unnest(range(1, whole - m + 2)) AS i FROM parts),
longer AS (SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS longer FROM inner_parts GROUP BY ALL),
kept AS (SELECT c.* FROM words c LEFT JOIN longer o ON o.lang = c.lang AND o.phrase = c.phrase WHERE c.m > 1 AND (longer IS NULL OR 100 * longer < 100 * a)),
cuts AS (SELECT lang, phrase, m, a, w, unnest(range(1, m)) AS k FROM kept),
scores AS (SELECT c.lang, c.phrase, c.a, o.a AS l, t.a AS r, n, k, 1000 * c.a::HUGEINT * n::HUGEINT // (o.a::HUGEINT * t.a::HUGEINT) AS score
  FROM cuts c JOIN counts o ON o.lang = c.lang AND o.phrase = array_to_string(w[1 : k], ' ')
  JOIN counts t ON t.lang = c.lang AND t.phrase = array_to_string(w[k + 1 : c.m], ' ') JOIN total ON total.lang = c.lang),
worst AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM worst QUALIFY rank <= 2000
"""

OP12_SQL = """
WITH rows AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS length FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, least(1, greatest(-1, list_dot_product(q.v, c.v) / (q.length * c.length))) AS score
  FROM rows q JOIN rows c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 50 = 0 AND q.length > 0 AND c.length > 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM pairs QUALIFY rank <= 5
"""

OP13_SQL = """
WITH rows AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, c.label = a.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score
  FROM rows a JOIN rows c ON len(c.v) = len(a.v) WHERE a.vec_id % 100 = 0),
positives AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same AND other_id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score QUALIFY rank <= 5
"""

ORACLE_SQL: dict[str, str] = {
    "op5_minmax": OP5_SQL,
    "op6_lines": OP6_SQL,
    "op8_decontamination": OP8_SQL,
    "op11_phrases": OP11_SQL,
    "op12_nearest": OP12_SQL,
    "op13_negatives": OP13_SQL,
}
