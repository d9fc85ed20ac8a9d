"""From raw documents to packed sequences: each stage works on all that the one before has kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
gives a DataFrame, which is written as Parquet and read again as the next
one's documents.  All but the last give the columns of ``documents``.

1. ``quality`` drops documents that the base checks or the proven cutoffs reject.
2. ``language`` drops documents without a letter or of no clear language.
3. ``near_duplicates`` keeps one document of each group of near copies.
4. ``repeats`` cuts passages that occur again out of the texts, whole characters only.
5. ``packing`` cuts and packs the ids of what is left into sequences.

A null text is rejected by the first stage, as is one without ten words; repeated
rows are near copies of each other; columns beside those of ``documents`` travel along.
A stage's result should be written before the variable that holds it goes: its
own tables may then be removed by the next call of a stage.
"""

from __future__ import annotations

import weakref

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siftrank.llm import jaccard_join, language_id, packing, quality_rules, suffix_dedup
from siftrank.scratch import remove_folders, scratch_path, tagged_folders


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


_calls: list[tuple[weakref.ref, list[str]]] = []  # results of stage calls, and the tables that only they read


def _stage(function):
    """The stage.  Tables that an earlier call has made for a result that nobody holds any more are removed first."""
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for call in [c for c in _calls if c[0]() is None]:
            _calls.remove(call)
            remove_folders(spark, call[1])
        with tagged_folders() as made:
            result = function(spark, docs, sf_dir)
        _calls.append((weakref.ref(result), made))
        return result

    return stage


STAGES = [
    ("quality", _stage(quality)), ("language", _stage(language)), ("near_duplicates", _stage(near_duplicates)),
    ("repeats", _stage(repeats)), ("packing", _stage(pack)),
]

# A trained network, components of links and suffix arrays have no SQL.  Tests hold the operators against brute force,
# and the stages against them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage_{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
