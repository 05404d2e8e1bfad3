"""The pipeline's stages on one directory, each against what it should do to its own input."""

import corpus_pipeline
import pytest

from spanloom.llm import common

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = common.table(spark, SF, "documents")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(common.materialise(stage(spark, out[-1], SF)))
    return out


def test_stages_shrink_and_keep_columns(stages):
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in stages]
    for before, after in zip(ids, ids[1:], strict=False):
        assert after <= before
    assert all(s.columns == stages[0].columns for s in stages[1:-1]) and ids[-1] == ids[-2]
    assert len(ids[1]) > 0.95 * len(ids[0])


def test_one_document_of_each_group_stays(spark, stages):
    """By what the lines' removal left, and then by the texts in documents."""
    from tests.llm.test_operators import brute_components

    before = [(r.doc_id, r.text) for r in stages[2].select("doc_id", "text").collect()]
    kept = {k[2] for k in brute_components(before)}
    whole = [(r.doc_id, r.text) for r in stages[0].select("doc_id", "text").collect() if r.doc_id in kept]
    assert {r.doc_id for r in stages[3].collect()} == {k[2] for k in brute_components(whole)}


def test_near_copies_that_lost_other_lines(spark, tmp_path):
    """Near copies of which the first keeps its boilerplate and the others lose it are found; documents that share boilerplate only stay."""
    import random

    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    boiler = [" ".join(word() for _ in range(12)) for _ in range(4)]
    rows, copies = [], set()
    for group in range(40):
        own = [word() for _ in range(60)]
        for copy in range(3):
            w = list(own)
            for _ in range(copy):
                w[r.randrange(60)] = word()
            i = len(rows)
            rows.append((i, "\n".join([*(boiler if copy != 1 else boiler[:2]), " ".join(w)]), "en", f"site{i % 9}", 1))
            if copy:
                copies.add(i)
        rows.append((len(rows), "\n".join([*boiler, " ".join(word() for _ in range(60))]), "en", f"site{len(rows) % 9}", 1))
    path = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    docs = common.table(spark, path, "documents")
    left = common.materialise(corpus_pipeline.drop_lines(spark, docs, path))
    kept = {x.doc_id for x in corpus_pipeline.deduplicate(spark, left, path).collect()}
    assert len(copies & kept) <= 0.1 * len(copies) and {x[0] for x in rows} - copies <= kept | {x[0] for x in rows if x[0] not in {y.doc_id for y in left.collect()}}


def test_lines_by_brute_force(spark, stages):
    """The second stage, from the rules alone, on what the first one kept."""
    from tests.llm.test_operators import brute_lines, words

    before = stages[1].select("doc_id", "text", "source").collect()
    want = brute_lines([(r.doc_id, r.text) for r in before], [r.source for r in before], 5)
    got = [(r.doc_id, r.text, r.n_chars) for r in stages[2].select("doc_id", "text", "n_chars").collect()]
    assert sorted((i, t) for i, t, _ in got) == sorted((i, t) for i, t in want.elements() if words(t)) and all(n == len(t) for _, t, n in got)


def test_languages_by_labels(spark, stages):
    """The first stage drops what has no letters; the languages it finds are those declared, but for a few."""
    from spanloom.llm import langid

    found = langid.text_languages(stages[0]).toPandas()
    kept = {r.doc_id for r in stages[1].select("doc_id").collect()}
    assert kept == set(found.doc_id[found.accepted]) and (found.language[found.accepted] == found.declared[found.accepted]).mean() > 0.97


def test_stages_on_awkward_tables(spark, stages):
    """Null, empty, repeated and long rows among others, an empty table, and tables without n_chars."""
    base = next(r.text for r in stages[4].orderBy("doc_id").collect() if r.lang == "en" and len(r.text) > 400 and "\n" not in r.text)
    words = base.split()
    long = " ".join(words[i * i % len(words)] + words[i % 7] for i in range(9_000))
    known = stages[0].select("doc_id", "text", "lang", "source")
    rows = [(-5, base, "en", "s"), (-5, base, "en", "s"), (-4, None, None, None), (None, base, "en", "t"), (-3, "", "en", "s"), (-2, long, "en", "u"), (None, None, None, None)]
    for docs, want in ((known.union(spark.createDataFrame(rows, known.schema)), [-5, -5, -2]), (known.limit(0), [])):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = common.materialise(stage(spark, docs, SF))
            assert docs.columns == ["doc_id", "text", "lang", "source"]
        assert sorted(r.doc_id for r in docs.where("doc_id < 0 or doc_id is null").collect()) == want
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_no_benchmark_item_is_left(spark, stages):
    from spanloom.llm.containment import contained_items

    assert contained_items(stages[4], common.table(spark, SF, "benchmark")).count() == 0
    bad = contained_items(stages[3], common.table(spark, SF, "benchmark")).select("doc_id").distinct()
    assert stages[4].count() == stages[3].count() - bad.count()


def test_run_equals_the_stages(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, stages[-1].collect()))
