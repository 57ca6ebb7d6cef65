"""The registered queries against their SQL, and the pipeline's stages against their rules."""

import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from oracle import connect, same  # noqa: E402

import corpus_pipeline  # noqa: E402
from tracelake.llm import decontaminate, jaccard_join, secret_scan  # noqa: E402
from tracelake.llm.queries import oracle_sql, queries  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    same(queries()[name](spark, SF), connect(SF), oracle_sql()[name])


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries()) == list(range(1, 14))


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    columns, before = docs.columns, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, SF).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "mixing":
            assert after.columns == columns
        if name == "toxicity":
            assert 0 < after.count() < before.count()
        elif name == "jaccard":
            groups = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(before).collect()}
            assert {r.doc_id for r in after.collect()} == set(groups.values())
        elif name == "decontamination":
            assert after.count() == before.count() and not decontaminate.contamination_report(after, bench).where("contaminated").count()
            hit = {r.doc_id for r in decontaminate.contamination_report(before, bench).where("contaminated").collect()}
            old = {r.doc_id: r.text for r in before.collect()}
            assert all((r.text == old[r.doc_id]) == (r.doc_id not in hit) for r in after.collect())
        elif name == "secrets":
            assert after.count() == before.count() and secret_scan.secret_report(after).where("spans <> ''").count() == 0
        before = after
    assert sorted(map(repr, corpus_pipeline.run(spark, SF).collect())) == sorted(map(repr, before.collect()))


CLASHING = ("score", "h", "spans", "size", "id", "of", "row", "component_id", "n_hit", "taken", "_n", "part", "k")


def _odd_tables(spark, path, docs, labels, items):
    columns = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in CLASHING)
    spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), *([7] * len(CLASHING))) for i, t, lang, s in docs], columns).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, ties, repeated rows and clashing names, against what each stage has to do."""
    words = lambda a, n: " ".join(f"w{a}x{i}" for i in range(n))
    item = words("bench", 12)
    long_ = words("long", 200_000)
    docs = [
        (1, words(1, 40), "en", "a"), (2, words(1, 40), None, None), (3, None, "en", "a"), (4, "", None, "b"), (5, " \t\n", "en", ""),
        (6, long_, "en", "a"), (7, long_ + " more", "en", "a"), (8, "before it " + item + " after it", "en", "b"), (9, 'the token = "abcdef123" here', "en", "b"),
        (10, words(10, 30), "en", None), (10, words(10, 30), "en", None), (None, words(11, 30), "en", "a"), (None, None, None, None), (12, "é \U0001f600 " + words(12, 3), "xx", "c"),
    ]
    labels = [(1, 1, 0), (None, 0, 1), (2, None, None), (99, 1, 1), (1, 1, 0)]
    _odd_tables(spark, tmp_path, docs, labels, [(1, item), (1, item), (None, item), (2, None), (3, "")])
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    before, kept = table, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        before = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "mixing":
            assert before.columns == table.columns
            assert before.where(" or ".join(f"`{c}` <> 7 or `{c}` is null" for c in CLASHING)).count() == 0
        kept[name] = before.collect()
    ids = lambda name: sorted((r.doc_id is None, r.doc_id) for r in kept[name])
    everything = sorted((i is None, i) for i, *_ in docs)
    assert ids("toxicity") == everything  # labels of one kind: no lexicon, nothing is toxic
    assert ids("jaccard") == ids("secrets") == ids("mixing") == [x for x in everything if x[1] not in (2, 7)]
    text = lambda name, i: next(r.text for r in kept[name] if r.doc_id == i)
    cut = text("decontamination", 8)
    assert "before it" in cut and "after it" in cut and "wbench" not in cut
    assert "abcdef123" not in text("secrets", 9) and text("secrets", 9).endswith("here")
    for i in (1, 3, 4, 5, 6, 10, 12):
        assert text("secrets", i) == next(t for d, t, *_ in docs if d == i)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in kept["secrets"])
    again = sorted(map(repr, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    assert again == sorted(map(repr, kept["mixing"]))


def test_pipeline_of_empty_tables(spark, tmp_path):
    _odd_tables(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
