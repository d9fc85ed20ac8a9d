import os

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from siftrank.llm import jaccard_join, queries, suffix_dedup
from siftrank.scratch import materialize, scratch_path, settled


def test_stages_of_odd_rows(spark, sf, rows, tmp_path):
    for start, docs in (("odd", rows), ("empty", rows.limit(0))):
        for name, stage in corpus_pipeline.STAGES:
            out = f"{tmp_path}/{start}_{name}"
            stage(spark, docs, sf).write.parquet(out)
            before, docs = docs, spark.read.parquet(out)
            assert name == "packing" or docs.columns == before.columns


def test_pipeline(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert all(kept[b] <= kept[a] for a, b in zip(names, names[1:]))
    good = spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").join(
        spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").filter(F.size(F.split("text", " ")) > 30)
    clean = {r.doc_id for r in good.select("doc_id").collect()}
    assert len(clean & kept["language"]) >= 0.97 * len(clean)
    assert kept["packing"] == kept["repeats"] == kept["near_duplicates"]
    assert corpus_pipeline.run(spark, sf).count() == docs.count()


def test_unread_results_stay_readable(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    first, second = stages["near_duplicates"](spark, docs, sf), stages["repeats"](spark, docs, sf)
    third = stages["packing"](spark, docs, sf)
    assert 0 < first.count() < docs.count() and second.count() == docs.count() and third.count() >= docs.count()
    assert first.count() > 0


def tables(spark):
    """Scratch tables on disk."""
    folder = os.path.dirname(scratch_path(spark, "none"))
    return set(os.listdir(folder.removeprefix("file:")))


def test_held_results_hold_few_tables(spark, sf):
    # A caller may still hold a stage's result while the next stage writes its own tables.
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    held = []
    for make, left in (
        (lambda: stages["near_duplicates"](spark, docs, sf), {"near_rows", "near_stay"}),
        (lambda: stages["repeats"](spark, docs, sf), {"suffix_met", "suffix_segments", "suffix_marks"}),
        (lambda: suffix_dedup.repeat_report(docs), {"suffix_met", "suffix_segments", "suffix_marks"}),
    ):
        before = tables(spark)
        held.append(make())
        assert {t.rsplit("-", 1)[0] for t in tables(spark) - before} == left
    before = tables(spark)
    held.append(jaccard_join.near_duplicates(docs))
    assert not {t.rsplit("-", 1)[0] for t in tables(spark) - before} & {"shingle_prefixes", "links"}
    assert [h.count() > 0 for h in held] == [True] * 4


def test_settled(spark):
    def rows(fail=False):
        first = settled(spark, "inner", lambda: materialize(spark.range(5), "innermost"))
        if fail:
            raise ValueError
        return materialize(first, "second").filter("id > 2")

    before = tables(spark)
    found = settled(spark, "outer", rows)
    assert {t.rsplit("-", 1)[0] for t in tables(spark) - before} == {"outer"}
    assert sorted(r.id for r in found.collect()) == [3, 4]
    before = tables(spark)
    with pytest.raises(ValueError):
        settled(spark, "outer", lambda: rows(fail=True))
    assert tables(spark) == before


def test_stages_decide_as_their_operators(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    judged = queries.QUERIES["op1_quality_rules"](spark, sf).collect()
    kept = {r.doc_id for r in stages["quality"](spark, docs, sf).select("doc_id").collect()}
    assert kept == {r.doc_id for r in judged if r.kept}
    linked = queries.QUERIES["op6_jaccard_join"](spark, sf).collect()
    stay = {r.doc_id for r in stages["near_duplicates"](spark, docs, sf).select("doc_id").collect()}
    assert stay == {r.component_id for r in linked}
    cut = {r.doc_id: r.n_removed for r in queries.QUERIES["op2_suffix_dedup"](spark, sf).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in stages["repeats"](spark, docs, sf).collect():
        removed = len((texts[r.doc_id] or "").encode()) - len((r.text or "").encode())
        assert cut[r.doc_id] - 8 <= removed <= cut[r.doc_id]  # whole characters only
    found = stages["language"](spark, docs, sf)
    assert found.columns == docs.columns and found.exceptAll(docs).count() == 0
    packed = stages["packing"](spark, docs, sf).collect()
    assert sorted(map(tuple, packed)) == sorted(map(tuple, queries.QUERIES["op3_packing"](spark, sf).collect()))
