"""Queries for repairs and similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.fixtures import Tables
from spanloom.functions.text import padded, shingles
from spanloom.operators import graph, parse, repair, similarity, vectors
from spanloom.plans.annotation import JOINED, TRIMMED
from spanloom.plans.oracle import Registry

R = Registry()
add = R.add

EDGE = "regexp_replace(span, '^[[:punct:]\\s]+|[[:punct:]\\s]+$', '', 'g')"
FIXED = f""", fixed AS (SELECT s.*, CASE WHEN instr(input, span) > 0 THEN CASE WHEN {TRIMMED} <> '' AND instr(input, {TRIMMED}) > 0 THEN {TRIMMED} ELSE span END WHEN {EDGE} <> '' AND instr(input, {EDGE}) > 0 THEN {EDGE} END AS fixed FROM {JOINED})
"""

#: A pattern that matches a span's words, whatever white space parts them.
LOOSE = r"regexp_replace(regexp_escape(trim(span)), '(\\?\s)+', '\\s+', 'g')"
ALIGNED = f"CASE WHEN instr(input, span) > 0 THEN span WHEN {EDGE} <> '' AND instr(input, {EDGE}) > 0 THEN {EDGE} WHEN trim(span) <> '' AND regexp_matches(input, {LOOSE}) THEN regexp_extract(input, {LOOSE}) END"
add("d01_aligned", lambda t: repair.aligned(t.spans, t.rows), f"SELECT s.*, {ALIGNED} AS fixed FROM {JOINED}")
SQUEEZED = r"trim(regexp_replace(span, '\s+', ' ', 'g'))"


def anywhere(value: str) -> str:
    return f"CASE WHEN {value} = '' THEN NULL WHEN instr(input, {value}) > 0 THEN {value} WHEN instr(lower(input), lower({value})) > 0 THEN substr(input, instr(lower(input), lower({value})), length({value})) END"


#: The longest common run: all runs of the span that are long enough, the longest and then the first in the text wins.
RECOVERED = f""", quick AS (SELECT s.*, input, CASE WHEN span <> '' AND input <> '' THEN coalesce({anywhere("span")}, {anywhere("trim(span)")}, {anywhere(SQUEEZED)}) END AS q FROM {JOINED}),
open_spans AS (SELECT DISTINCT span, input FROM quick WHERE q IS NULL AND span <> '' AND input <> ''),
sized AS (SELECT span, input, unnest(range(greatest(4, floor(length(span) * 0.7))::BIGINT, length(span) + 1)) AS n FROM open_spans),
pieces AS (SELECT span, input, n, substr(lower(span), i, n) AS run FROM (SELECT span, input, n, unnest(range(1, length(span) - n + 2)) AS i FROM sized)),
best AS (SELECT span, input, n, instr(lower(input), run) AS place FROM pieces WHERE instr(lower(input), run) > 0 QUALIFY row_number() OVER (PARTITION BY span, input ORDER BY n DESC, place) = 1),
recovered AS (SELECT k.* EXCLUDE (q), coalesce(q, substr(k.input, place, n)) AS fixed FROM quick k LEFT JOIN best b ON b.span = k.span AND b.input = k.input)
"""
add("d04_recovered", lambda t: repair.recovered(t.spans, t.rows), RECOVERED + "SELECT * EXCLUDE (input) FROM recovered")
add(
    "d05_autocleaned",
    lambda t: repair.autocleaned(t.spans, t.rows),
    RECOVERED + f""", now AS (SELECT task_id, row_index, field, type, pos, input, fixed AS span FROM recovered WHERE fixed IS NOT NULL), bare AS (SELECT task_id, row_index, field, type, pos, CASE WHEN {TRIMMED} <> '' AND instr(input, {TRIMMED}) > 0 THEN {TRIMMED} ELSE span END AS span FROM now)
SELECT task_id, row_index, field, type, pos, span FROM (SELECT *, first_value(type) OVER (PARTITION BY task_id, row_index, field, span ORDER BY pos) AS first_type FROM bare) WHERE field <> 'entities' OR type = first_type""",
)
RENAMES, KNOWN = {"typea": "type1", "typeb": "type1"}, ["type1", "type2", "type6", "type7", "type8", "type9", "other"]
PRELABELS = f""", renamed AS (SELECT task_id, row_index, field, CASE WHEN type IN ('typea', 'typeb') THEN 'type1' ELSE type END AS type, span, min(pos) AS pos FROM spans WHERE type IN ('typea', 'typeb', 'type1', 'type2', 'type6', 'type7', 'type8', 'type9', 'other') GROUP BY ALL),
moved AS (SELECT task_id, row_index, CASE WHEN type IN (SELECT type FROM type_enum GROUP BY type HAVING count(DISTINCT field) = 2) THEN CASE WHEN instr(span, ' ') > 0 THEN 'json_structures' ELSE 'entities' END ELSE field END AS field, type, span, min(pos) AS pos FROM renamed GROUP BY ALL),
whole AS (SELECT s.task_id, s.row_index, field, type, pos, {ALIGNED} AS fixed FROM moved s JOIN src_rows r ON r.task_id = s.task_id AND r.row_index = s.row_index),
once AS (SELECT task_id, row_index, field, type, fixed AS span, min(pos) AS pos FROM whole WHERE fixed IS NOT NULL GROUP BY ALL)
"""
add(
    "d12_prelabel_fixes",
    lambda t: repair.prelabel_fixes(t.spans, t.rows, t.type_enum, RENAMES, KNOWN)[0],
    PRELABELS + "SELECT task_id, row_index, field, type, span, pos FROM (SELECT *, first_value(type) OVER (PARTITION BY task_id, row_index, field, span ORDER BY pos, type) AS first_type FROM once) WHERE field <> 'entities' OR type = first_type",
)
add("d12_prelabel_stubs", lambda t: repair.prelabel_fixes(t.spans, t.rows, t.type_enum, RENAMES, KNOWN)[1].groupBy("task_id").agg(F.count("*").alias("n_stubs")), "SELECT task_id, count(*) AS n_stubs FROM src_rows ANTI JOIN spans USING (task_id, row_index) GROUP BY task_id")
add(
    "d13_row_ids",
    lambda t: repair.with_row_ids(t.spans.select("task_id", "row_index").distinct(), t.rows.where("row_index % 3 > 0").select("task_id", "row_index", F.concat(F.lit("r"), F.col("row_index").cast("string")).alias("row_id"))),
    "SELECT DISTINCT task_id, row_index, CASE WHEN row_index % 3 > 0 THEN concat('r', row_index::VARCHAR) ELSE concat('row-', row_index::VARCHAR) END AS row_id FROM spans",
)
add("d02_safe_fixes", lambda t: repair.safe_fixes(t.spans, t.rows), FIXED + "SELECT * FROM fixed")
add(
    "d03_rerouted",
    lambda t: repair.rerouted(t.spans, t.type_enum),
    "SELECT task_id, row_index, f AS field, type, span, min(pos) AS pos, bool_or(f <> field) AS moved FROM (SELECT *, CASE WHEN type IN (SELECT type FROM type_enum GROUP BY type HAVING count(DISTINCT field) = 2) THEN CASE WHEN instr(span, ' ') > 0 THEN 'json_structures' ELSE 'entities' END ELSE field END AS f FROM spans) GROUP BY ALL",
)


def decisions(t: Tables):
    return t.spark.createDataFrame([("The", "other", "typea"), ("Of", "other", None), ("In", "other", "type1")], "span string, old_type string, new_type string")


add(
    "d06_retyped",
    lambda t: repair.retyped(t.spans, decisions(t), t.type_enum),
    "SELECT task_id, row_index, CASE WHEN old IS NULL THEN field WHEN new_type = 'typea' THEN 'json_structures' ELSE 'entities' END AS field, CASE WHEN old IS NULL THEN type ELSE new_type END AS type, span, min(pos) AS pos FROM (SELECT * FROM spans LEFT JOIN (VALUES ('The', 'other', 'typea'), ('Of', 'other', NULL), ('In', 'other', 'type1')) d(s, old, new_type) ON span = s AND type = old) WHERE old IS NULL OR new_type IS NOT NULL GROUP BY ALL",
)


def picks(t: Tables):
    return t.spans.where("span = 'The' and pos < 3").select("task_id", "row_index", "span", F.lit("entities").alias("field"), F.lit("type2").alias("type")).distinct()


add(
    "d07_picked",
    lambda t: repair.picked(t.spans, picks(t)),
    ", picks AS (SELECT DISTINCT task_id, row_index, span, 'entities' AS field, 'type2' AS type FROM spans WHERE span = 'The' AND pos < 3) SELECT DISTINCT task_id, row_index, field, type, span FROM spans ANTI JOIN picks USING (task_id, row_index, span) UNION SELECT task_id, row_index, field, type, span FROM picks",
)
add(
    "d08_bulk_removed",
    lambda t: repair.bulk_removed(t.spans, t.spark.createDataFrame([("the",), ("of",), ("in",)], "span_lower string"), t.tasks),
    "SELECT s.* FROM spans s JOIN tasks USING (task_id) WHERE NOT (status = 'accepted' AND lower(span) IN ('the', 'of', 'in'))",
)
add(
    "d09_write_time",
    lambda t: repair.write_time(t.spans, t.rows),
    FIXED + ", now AS (SELECT f.task_id, f.row_index, f.pos, field, type, coalesce(fixed, span) AS span FROM fixed f) SELECT n.task_id, n.row_index, field, type, span, min(pos) AS pos FROM now n JOIN src_rows r ON r.task_id = n.task_id AND r.row_index = n.row_index WHERE instr(input, span) > 0 GROUP BY ALL",
)
add(
    "d09_write_time_counts",
    lambda t: repair.write_time_counts(t.spans, t.rows),
    FIXED + ", now AS (SELECT f.task_id, f.row_index, coalesce(fixed, span) AS span FROM fixed f), n AS (SELECT n.task_id, count(*) AS n_total, count(*) FILTER (instr(input, span) = 0) AS n_stripped FROM now n JOIN src_rows r ON r.task_id = n.task_id AND r.row_index = n.row_index GROUP BY n.task_id), m AS (SELECT task_id, count(*) AS n_stubs FROM src_rows ANTI JOIN spans USING (task_id, row_index) GROUP BY task_id) SELECT task_id, coalesce(n_total, 0) AS n_total, coalesce(n_stripped, 0) AS n_stripped, coalesce(n_stubs, 0) AS n_stubs FROM n FULL JOIN m USING (task_id)",
)
add(
    "d10_rules_cleanup",
    lambda t: repair.rules_cleanup(t.spans, "typec", "(ed|ing)"),
    r""", a AS (SELECT * FROM spans s WHERE NOT (field = 'json_structures' AND type = 'typec' AND (NOT regexp_matches(span, '(ed|ing)') OR EXISTS (FROM spans e WHERE e.field = 'entities' AND e.task_id = s.task_id AND e.row_index = s.row_index AND lower(e.span) = lower(s.span))))),
b AS (SELECT * FROM a WHERE NOT (regexp_matches(span, 'X{4,}|x{4,}|\*{3,}|(?i)\[(?:redacted|removed)\]') AND type <> 'time'))
SELECT * FROM b WHERE NOT EXISTS (FROM b c WHERE c.task_id = b.task_id AND c.row_index = b.row_index AND c.type = b.type AND c.span <> b.span AND instr(c.span, b.span) > 0)""",
)
add(
    "d11_recoverable_tasks",
    lambda t: repair.recoverable_tasks(t.spans, t.rows, t.tasks),
    FIXED
    + f""", own AS (SELECT f.* FROM fixed f JOIN tasks USING (task_id) WHERE status = 'human_review'), now AS (SELECT task_id, row_index, pos, field, type, coalesce(fixed, span) AS span FROM own),
bad AS (SELECT n.task_id FROM now n JOIN src_rows r ON r.task_id = n.task_id AND r.row_index = n.row_index WHERE instr(input, span) = 0 OR ({TRIMMED} <> span AND {TRIMMED} <> '' AND instr(input, {TRIMMED}) > 0) UNION SELECT task_id FROM (SELECT *, first_value(type) OVER (PARTITION BY task_id, row_index, span ORDER BY pos) AS ft FROM now WHERE field = 'entities') WHERE ft <> type)
SELECT task_id, count(*) FILTER (fixed IS NOT NULL AND fixed <> span) AS n_changed FROM own WHERE task_id NOT IN (SELECT task_id FROM bad) GROUP BY task_id""",
)
add(
    "d14_decision_diff",
    lambda t: repair.decision_diff(t.spans.withColumn("type", F.when(F.md5("span").startswith("0"), "other").otherwise(F.col("type"))), t.spans),
    "SELECT task_id, span_lower, row_index, type, old_type FROM (SELECT *, row_number() OVER (PARTITION BY task_id, span_lower ORDER BY row_index, pos) AS k FROM (SELECT n.*, o.type AS old_type FROM (SELECT task_id, row_index, lower(span) AS span_lower, CASE WHEN md5(span) LIKE '0%' THEN 'other' ELSE type END AS type, pos FROM spans WHERE field = 'entities' QUALIFY row_number() OVER (PARTITION BY task_id, row_index, lower(span) ORDER BY pos) = 1) n LEFT JOIN (SELECT task_id, row_index, lower(span) AS span_lower, type FROM spans WHERE field = 'entities' QUALIFY row_number() OVER (PARTITION BY task_id, row_index, lower(span) ORDER BY pos) = 1) o USING (task_id, row_index, span_lower)) WHERE old_type IS NULL OR old_type <> type) WHERE k = 1",
)

# --- similarity ------------------------------------------------------------------------------------------------------------


def row_texts(t: Tables):
    return t.rows.select(similarity.row_key().alias("key"), F.col("input").alias("text"))


def task_texts(t: Tables):
    return parse.task_text(t.rows, t.row_masks).select(F.col("task_id").alias("key"), "text")


def masked_keys(t: Tables):
    return t.row_masks.select(similarity.row_key().alias("key"))


def row_clusters(t: Tables, masked=None):
    return similarity.clusters(row_texts(t), 3, 0.5, masked_keys(t) if masked is None else masked)


def duplicate_masks(t: Tables):
    masked = graph.written(masked_keys(t))  # both the clusters and the masks ask for them
    return similarity.mask_duplicates(row_clusters(t, masked), masked)


def report(t: Tables):
    return similarity.dedup_report(row_clusters(t), row_texts(t), masked_keys(t))


TASK_TEXTS = "SELECT task_id AS key, string_agg(input, chr(10) ORDER BY row_index) AS text FROM src_rows ANTI JOIN row_masks USING (task_id, row_index) GROUP BY task_id"
KEY = "concat(task_id, ':', lpad(row_index::VARCHAR, 8, '0'))"


def sets_sql(n: int, texts: str) -> str:
    """CTEs items (key, items), reps, edges of distinct sets, and clusters."""
    return f""", texts AS ({texts}), tokens AS (SELECT key, regexp_extract_all(lower(text), '\\S+') AS w FROM texts),
items AS (SELECT key, list_sort(list_distinct(CASE WHEN len(w) < {n} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i : i + {n - 1}], ' ')) END)) AS items FROM tokens WHERE len(w) > 0),
sets AS (SELECT items, min(key) AS key FROM items GROUP BY items), member AS (SELECT key, unnest(items) AS x FROM sets)"""


def edges_sql(threshold: float) -> str:
    return f""", edges AS (SELECT a.key AS a, b.key AS b, count(*) / (any_value(len(p.items)) + any_value(len(q.items)) - count(*)) AS similarity FROM member a JOIN member b ON a.x = b.x AND a.key < b.key JOIN sets p ON p.key = a.key JOIN sets q ON q.key = b.key GROUP BY a.key, b.key HAVING similarity >= {threshold})"""


def clusters_sql(threshold: float, excluded: str) -> str:
    return f""", links AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges UNION SELECT s.key, i.key FROM items i JOIN sets s ON s.items = i.items WHERE s.key <> i.key UNION SELECT i.key, s.key FROM items i JOIN sets s ON s.items = i.items WHERE s.key <> i.key),
reach AS (SELECT DISTINCT a AS node, a AS other FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other),
roots AS (SELECT node, min(other) AS root FROM reach GROUP BY node), reps AS (SELECT root, coalesce(min(node) FILTER (node NOT IN ({excluded})), min(node)) AS rep FROM roots GROUP BY root),
scored AS (SELECT node AS key, rep, len(list_intersect(x.items, y.items)) / (len(x.items) + len(y.items) - len(list_intersect(x.items, y.items))) AS similarity FROM roots JOIN reps USING (root) JOIN items x ON x.key = node JOIN items y ON y.key = rep),
kept AS (SELECT *, count(*) OVER (PARTITION BY rep) AS size FROM scored WHERE similarity >= {threshold}), clusters AS (SELECT * FROM kept WHERE size > 1)
"""


ROW_SETS = sets_sql(3, f"SELECT {KEY} AS key, input AS text FROM src_rows")
ROW_CLUSTERS = ROW_SETS + edges_sql(0.5) + clusters_sql(0.5, f"SELECT {KEY} FROM row_masks")
TASK_EDGES = sets_sql(5, TASK_TEXTS) + edges_sql(0.7)

add("f01_shingle_counts", lambda t: row_texts(t).select("key", F.size(shingles(F.col("text"), 3)).alias("n")).where("n > 0"), ROW_SETS + "SELECT key, len(items)::INT AS n FROM items")
add("f02_minhash", lambda t: similarity.minhash(similarity.shingle_sets(task_texts(t), 5)).select("key", "signature").select("key", F.sha2(F.array_join(F.col("signature").cast("array<string>"), ","), 256).alias("digest")))
add("f03_lsh_edges", lambda t: similarity.near_duplicate_edges(task_texts(t), 5, 0.7, "lsh").select("a", "b", F.round("similarity", 6).alias("similarity")))
add("f04_task_edges", lambda t: similarity.near_duplicate_edges(task_texts(t), 5, 0.7).select("a", "b", F.round("similarity", 6).alias("similarity")), TASK_EDGES + "SELECT a, b, round(similarity, 6) AS similarity FROM edges")
add(
    "f05_components",
    lambda t: similarity.text_components(task_texts(t), 5, 0.5),
    sets_sql(5, TASK_TEXTS)
    + edges_sql(0.5)
    + ", both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges), reach AS (SELECT DISTINCT a AS node, a AS other FROM both_ways UNION SELECT r.node, l.b FROM reach r JOIN both_ways l ON l.a = r.other) SELECT node, min(other) AS root FROM reach GROUP BY node",
)
add(
    "f04_linked_texts",
    lambda t: similarity.linked_texts(task_texts(t), 5, 0.5),
    sets_sql(5, TASK_TEXTS)
    + edges_sql(0.5)
    + """, same AS (SELECT i.key, s.key AS rep FROM items i JOIN sets s ON s.items = i.items), n AS (SELECT rep, count(*) AS copies FROM same GROUP BY rep), both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT rep AS node, rep AS other FROM n UNION SELECT r.node, l.b FROM reach r JOIN both_ways l ON l.a = r.other), roots AS (SELECT node, min(other) AS root FROM reach GROUP BY node), links AS (SELECT a, sum(copies)::BIGINT AS n FROM both_ways JOIN n ON n.rep = b GROUP BY a)
SELECT key, same.rep, root, coalesce(links.n, 0) + copies - 1 AS n_links FROM same JOIN roots ON node = same.rep JOIN n ON n.rep = same.rep LEFT JOIN links ON a = same.rep""",
)
add("f06_row_clusters", lambda t: row_clusters(t).withColumn("similarity", F.round("similarity", 6)), ROW_CLUSTERS + "SELECT key, rep, round(similarity, 6) AS similarity, size FROM clusters")
add("f07_cluster_summary", lambda t: similarity.cluster_summary(row_clusters(t)), ROW_CLUSTERS + "SELECT rep, count(*) AS size, round(avg(similarity) FILTER (key <> rep), 6) AS mean_similarity FROM clusters GROUP BY rep")
add(
    "f07_pairwise_summary",
    lambda t: similarity.text_pairwise_summary(row_texts(t), 3, 0.5, masked_keys(t)).withColumn("mean_similarity", F.round("mean_similarity", 6)),
    ROW_CLUSTERS + """, pairs AS (SELECT c.rep, avg(len(list_intersect(x.items, y.items)) / (len(x.items) + len(y.items) - len(list_intersect(x.items, y.items)))) AS mean FROM clusters c JOIN clusters d ON d.rep = c.rep AND c.key < d.key JOIN items x ON x.key = c.key JOIN items y ON y.key = d.key GROUP BY c.rep)
SELECT c.rep, count(*) AS size, round(any_value(mean), 6) AS mean_similarity FROM clusters c JOIN pairs p ON p.rep = c.rep GROUP BY c.rep UNION ALL SELECT key, 1, 1.0::DOUBLE FROM items WHERE key NOT IN (SELECT key FROM clusters)""",
)
add("f08_rejects", lambda t: similarity.rejects(row_clusters(t)), ROW_CLUSTERS + "SELECT key, rep FROM clusters QUALIFY key <> min(key) OVER (PARTITION BY rep)")
add(
    "f09_dedup_report",
    lambda t: report(t).select("key", "rep", "size", "n_words", "masked", F.length("preview").alias("n_preview")),
    ROW_CLUSTERS + f"SELECT c.key, rep, size, len(regexp_extract_all(input, '\\S+'))::INT AS n_words, c.key IN (SELECT {KEY} FROM row_masks) AS masked, length(CASE WHEN regexp_matches(input, '^(\\s*\\S+){{100}}') THEN regexp_extract(input, '^(\\s*\\S+){{100}}') ELSE input END)::INT AS n_preview FROM clusters c JOIN (SELECT {KEY} AS key, input FROM src_rows) r ON r.key = c.key",
)
add("f10_mask_duplicates", duplicate_masks, ROW_CLUSTERS + f"SELECT key, concat('near-duplicate of ', rep) AS reason FROM (SELECT key, rep FROM clusters QUALIFY key <> min(key) OVER (PARTITION BY rep)) WHERE key NOT IN (SELECT {KEY} FROM row_masks)")
add(
    "f11_slider",
    lambda t: similarity.slider(similarity.with_word_counts(row_clusters(t), row_texts(t)), 0.6),
    ROW_CLUSTERS + f", v AS (SELECT c.key, rep, similarity / ln(len(regexp_extract_all(input, '\\S+')) / 10 + exp(1)) AS value FROM clusters c JOIN (SELECT {KEY} AS key, input FROM src_rows) r ON r.key = c.key) SELECT key, rep, left_size FROM (SELECT key, rep, count(*) OVER (PARTITION BY rep) AS left_size FROM v WHERE key = rep OR value >= 0.6) WHERE left_size > 1",
)
add(
    "f12_cosine_search",
    lambda t: similarity.cosine_search(t.source("embeddings").where("vec_id % 20 = 0"), t.source("embeddings"), 0.3).withColumn("cosine", F.round("cosine", 5)),
    "SELECT a.vec_id AS query, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3",
)

CLOSE = ", close AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE c >= 0.35), ways AS (SELECT a, b FROM close UNION SELECT b, a FROM close), reach AS (SELECT DISTINCT a AS node, a AS other FROM ways UNION SELECT r.node, l.b FROM reach r JOIN ways l ON l.a = r.other), roots AS (SELECT node, min(other) AS root FROM reach GROUP BY node), kept AS (SELECT node AS key, root AS rep, CASE WHEN node = root THEN 1.0 ELSE c END AS cosine FROM roots LEFT JOIN close ON a = root AND b = node WHERE node = root OR c IS NOT NULL)\n"
add(
    "f12_cosine_clusters",
    lambda t: vectors.cosine_clusters(t.source("embeddings"), 0.35).withColumn("cosine", F.round("cosine", 5)),
    CLOSE + "SELECT key, rep, round(cosine, 5)::DOUBLE AS cosine, count(*) OVER (PARTITION BY rep) AS size FROM kept QUALIFY size > 1",
)
add("f12_cosine_clusters_lsh", lambda t: vectors.cosine_clusters(t.source("embeddings"), 0.35, mode="lsh").withColumn("cosine", F.round("cosine", 5)))
add(
    "f13_mean_cosine",
    lambda t: similarity.mean_pairwise_cosine(t.source("embeddings"), "label").withColumn("mean_cosine", F.round("mean_cosine", 5)),
    "SELECT a.label AS cluster, any_value(n) AS size, round(coalesce(avg(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) FILTER (a.vec_id < b.vec_id), 1.0), 5) AS mean_cosine FROM embeddings a JOIN embeddings b ON a.label = b.label JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) c ON c.label = a.label GROUP BY a.label",
)


def mean_jaccard(t: Tables):
    members = graph.written(row_clusters(t))
    own = similarity.shingle_sets(row_texts(t).join(members.select("key"), "key", "left_semi"), 3)
    return similarity.mean_pairwise_jaccard(members, graph.written(similarity.minhash(own, 32)))


add("f13_mean_jaccard", mean_jaccard)
add("f21_embedding_map", lambda t: similarity.embedding_map(t.source("embeddings"), 1.15, 3, smallest=4))
NEAR = ", near AS (SELECT a.vec_id AS a, b.vec_id AS b, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embeddings a JOIN embeddings b ON list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) <= 1.15), cores AS (SELECT a FROM near GROUP BY a HAVING count(*) >= 3), ways AS (SELECT a, b FROM near WHERE a IN (FROM cores) AND b IN (FROM cores)), reach AS (SELECT a AS node, a AS other FROM cores UNION SELECT r.node, w.b FROM reach r JOIN ways w ON w.a = r.other), roots AS (SELECT node, min(other) AS root FROM reach GROUP BY node), border AS (SELECT a AS node, arg_min(b, struct_pack(d := d, b := b)) AS core FROM near WHERE a NOT IN (FROM cores) AND b IN (FROM cores) GROUP BY a), found AS (SELECT node, root, 'core' AS kind FROM roots UNION ALL SELECT border.node, root, 'border' FROM border JOIN roots ON roots.node = core), large AS (SELECT * FROM found QUALIFY count(*) OVER (PARTITION BY root) >= 4)\n"
add("f21_density_clusters", lambda t: vectors.density_clusters(t.source("embeddings"), 1.15, 3, 4).fillna(-1, ["cluster"]), NEAR + "SELECT vec_id, coalesce(root, -1) AS cluster, coalesce(kind, 'noise') AS kind FROM embeddings LEFT JOIN large ON node = vec_id")
add("f15_embedded", lambda t: similarity.embed(task_texts(t), similarity.random_embedder(16), 16))
add("f18_report_state", lambda t: similarity.report_state(similarity.fingerprint(row_texts(t).where("key >= 'doc-000001'")), similarity.fingerprint(row_texts(t))), f"SELECT CASE WHEN min({KEY}) < 'doc-000001' THEN 'stale' ELSE 'fresh' END AS state FROM src_rows")
add("f18_masked_since", lambda t: similarity.masked_since(row_clusters(t), masked_keys(t)), ROW_CLUSTERS + f"SELECT rep, count(*) AS n_masked FROM clusters WHERE key IN (SELECT {KEY} FROM row_masks) GROUP BY rep")
add("t04_largest_clusters", lambda t: similarity.largest_clusters(row_clusters(t), 20), ROW_CLUSTERS + "SELECT rep, any_value(size) AS size, row_number() OVER (ORDER BY any_value(size) DESC, rep)::INT AS place FROM clusters GROUP BY rep QUALIFY place <= 20")


def cached(t: Tables):
    texts = task_texts(t).select("key", similarity.content_hash(F.col("text")).alias("content_hash"))
    cache = t.source("embeddings").select(F.concat(F.lit("doc-"), padded(F.col("vec_id"), 6)).alias("key"), F.col("embedding").alias("vector"), "label")
    cache = cache.join(texts, "key").select("key", F.when(F.col("label") % 2 == 0, F.col("content_hash")).otherwise("old").alias("content_hash"), "vector")
    return texts, cache


CACHE = ", texts AS (SELECT task_id AS key, substr(sha256(string_agg(input, chr(10) ORDER BY row_index)), 1, 32) AS content_hash FROM src_rows ANTI JOIN row_masks USING (task_id, row_index) GROUP BY task_id), hits AS (SELECT key FROM embeddings e JOIN texts ON key = concat('doc-', lpad(vec_id::VARCHAR, greatest(6, length(vec_id::VARCHAR))::INT, '0')) WHERE label % 2 = 0 AND len(embedding) = 64)\n"
add("f14_cache_hits", lambda t: similarity.cache_lookup(*cached(t), 64)[0].select("key"), CACHE + "SELECT key FROM hits")
add("f14_cache_misses", lambda t: similarity.cache_lookup(*cached(t), 64)[1], CACHE + "SELECT key, content_hash FROM texts WHERE key NOT IN (SELECT key FROM hits)")
add("f17_content_hashes", lambda t: task_texts(t).select("key", similarity.content_hash(F.col("text")).alias("content_hash")), CACHE + "SELECT key, content_hash FROM texts")
add(
    "f17_fingerprint",
    lambda t: similarity.fingerprint(task_texts(t)),
    f", texts AS ({TASK_TEXTS}) SELECT count(*) AS n_texts, sum(concat('0x', substr(sha256(concat(key, '|', substr(sha256(text), 1, 32))), 1, 15))::BIGINT)::VARCHAR AS fingerprint FROM texts",
)
add(
    "f17_text_fingerprint",
    lambda t: similarity.fingerprint(row_texts(t)),
    f"SELECT count(*) AS n_texts, sum(concat('0x', substr(sha256(concat({KEY}, '|', substr(sha256(input), 1, 32))), 1, 15))::BIGINT)::VARCHAR AS fingerprint FROM src_rows",
)
add(
    "f19_unjustified_masks",  # masks that say a row is like the first of its task
    lambda t: similarity.unjustified_masks(t.row_masks.select(similarity.row_key().alias("key"), F.concat(F.lit("near-duplicate of "), "task_id", F.lit(":00000000")).alias("reason")), row_texts(t)).withColumn("similarity", F.round("similarity", 6)),
    ROW_SETS + f", m AS (SELECT {KEY} AS key, concat(task_id, ':00000000') AS rep FROM row_masks), e AS (SELECT m.key, m.rep, coalesce(len(list_intersect(x.items, y.items)) / nullif(len(list_distinct(list_concat(x.items, y.items))), 0), 0.0) AS s FROM m LEFT JOIN items x ON x.key = m.key LEFT JOIN items y ON y.key = m.rep) SELECT key, rep, round(coalesce(s, 0.0), 6) AS similarity FROM e WHERE coalesce(s, 0.0) < 0.05",
)
add(
    "f19_unjustified_duplicate_masks",  # masks of clusters at 0.5 that 0.6 no longer justifies
    lambda t: similarity.unjustified_masks(duplicate_masks(t), row_texts(t), 0.6).withColumn("similarity", F.round("similarity", 6)),
    ROW_CLUSTERS + f"SELECT key, rep, round(similarity, 6) AS similarity FROM (SELECT * FROM clusters QUALIFY key <> min(key) OVER (PARTITION BY rep)) WHERE key NOT IN (SELECT {KEY} FROM row_masks) AND key <> rep AND similarity < 0.6",
)
add(
    "f20_reject_tasks",
    lambda t: similarity.reject_tasks(similarity.clusters(task_texts(t), 5, 0.7), t.tasks),
    TASK_EDGES + clusters_sql(0.7, "SELECT 'none'") + "SELECT task_id, rep, status AS previous_status, CASE WHEN status = 'accepted' THEN 'rejected' END AS next_status FROM (SELECT key, rep FROM clusters QUALIFY key <> min(key) OVER (PARTITION BY rep)) c JOIN tasks ON task_id = key",
)
