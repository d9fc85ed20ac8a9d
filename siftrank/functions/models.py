"""Models supplied by the caller, and deterministic stand-ins for tests and examples."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from siftrank.functions.text import clean_query, let, term_counts, tokens
from siftrank.functions.vectors import l2_normalize

Encode = Callable[[list[str]], Sequence[Sequence[float]]]
Score = Callable[[list[str], list[str]], Sequence[float]]
Generate = Callable[[list[str]], Sequence[str | None]]


BATCH = 32         # texts in a call
IN_FLIGHT = 4      # calls that a worker keeps open
ATTEMPTS = 3
WAIT_SECONDS = 0.2  # before the second attempt, doubled for each further one


def persistent(call: Callable, attempts: int = ATTEMPTS, wait: float = WAIT_SECONDS) -> Callable:
    """The call, tried again after a growing pause when it fails; the last failure is the caller's."""
    def tried(*args: object) -> object:
        for attempt in range(1, attempts + 1):
            try:
                return call(*args)
            except Exception:  # the caller's model: any of its failures
                if attempt == attempts:
                    raise
                time.sleep(wait * 2 ** (attempt - 1))

    return tried


def in_order(call: Callable, batches: Iterable[tuple], in_flight: int = IN_FLIGHT) -> Iterator:
    """Results of the calls in the order of the batches, of which at most ``in_flight`` are open at a time.

    The next batch is sent as soon as the oldest one is answered, so a worker
    waits for its model, not the model for the worker.
    """
    with ThreadPoolExecutor(in_flight) as pool:
        opened: deque = deque()
        try:
            for batch in batches:
                if len(opened) == in_flight:
                    yield opened.popleft().result()
                opened.append(pool.submit(call, *batch))
            while opened:
                yield opened.popleft().result()
        finally:
            for call_ in opened:
                call_.cancel()


def pieces(size: int, *columns: Sequence) -> Iterator[tuple]:
    for at in range(0, len(columns[0]), size):
        yield tuple(list(c[at:at + size]) for c in columns)


def encoder(load: Callable[[], Encode], batch: int = BATCH, normalize: bool = True, in_flight: int = IN_FLIGHT,
            attempts: int = ATTEMPTS) -> Callable[[Column], Column]:
    """Text column to vector column; ``load`` runs once per Python worker.

    The model is called from ``in_flight`` threads; 1 for one that cannot bear it.
    """
    @pandas_udf("array<double>")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = persistent(load(), attempts)
        for texts in parts:
            vectors: list = []
            for values in in_order(model, pieces(batch, texts), in_flight):
                found = np.asarray(values, dtype=np.float64)
                if normalize:
                    norms = np.linalg.norm(found, axis=1, keepdims=True)
                    found = found / np.where(norms > 0, norms, 1.0)
                vectors.extend(found.tolist())
            yield pd.Series(vectors)

    return encode


def pair_scorer(load: Callable[[], Score], batch: int = BATCH, in_flight: int = IN_FLIGHT,
                attempts: int = ATTEMPTS) -> Callable[[Column, Column], Column]:
    """Query and text columns to a relevance column; ``load`` runs once per Python worker, calls as in ``encoder``."""
    @pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = persistent(load(), attempts)
        for queries, texts in parts:
            values = [v for found in in_order(model, pieces(batch, queries, texts), in_flight) for v in found]
            yield pd.Series(values, dtype="float64")

    return score


ANSWERS = "_key string, answer string, error string"


def ask(rows: DataFrame, load: Callable[[], Generate], answers: str, batch: int = BATCH,
        parallel: int | None = None, slices: int = 1, in_flight: int = IN_FLIGHT, attempts: int = 1) -> DataFrame:
    """``rows`` with an ``answer`` to each ``prompt``; each distinct prompt is asked once.

    Answers are kept in the parquet table at ``answers`` under the prompt's
    hash, before they are used.  They are written in ``slices`` by that hash, one
    job after another: what a finished slice has is never asked again, by a
    later slice or run; a task that fails asks its own batches again, and a job
    that fails loses its slice only.  A prompt whose model call fails has a null
    answer and the ``error`` (see ``ask_errors``), and is asked again on the next
    run.
    """
    spark = rows.sparkSession
    keyed = rows.withColumn("_key", F.sha2("prompt", 256))
    asked = keyed.select("_key", "prompt").dropDuplicates(["_key"])
    schema = ANSWERS
    spark.createDataFrame([], schema).write.mode("append").parquet(answers)
    known = spark.read.schema(schema).parquet(answers).filter("answer is not null")
    missing = asked.join(known, "_key", "left_anti")
    if parallel:
        missing = missing.repartition(parallel)

    def generate(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = persistent(load(), attempts)

        def answered(keys: list, prompts: list) -> pd.DataFrame:
            error = None
            try:
                texts = list(model(prompts))
            except Exception as failure:  # the caller's model; its failure means no answer
                texts, error = [None] * len(prompts), f"{type(failure).__name__}: {failure}"
            return pd.DataFrame({"_key": keys, "answer": texts, "error": error})

        for part in parts:
            yield from in_order(answered, pieces(batch, part["_key"], part["prompt"]), in_flight)

    for part in range(slices):
        own = missing.filter(F.pmod(F.xxhash64("_key"), F.lit(slices)) == part) if slices > 1 else missing
        own.mapInPandas(generate, schema).write.mode("append").parquet(answers)
    answered = spark.read.schema(schema).parquet(answers).filter("answer is not null").dropDuplicates(["_key"])
    return keyed.join(answered.drop("error"), "_key", "left").drop("_key")


def ask_errors(spark: SparkSession, answers: str) -> DataFrame:
    """How many calls failed with which error."""
    failed = spark.read.schema(ANSWERS).parquet(answers).filter("error is not null")
    return failed.groupBy("error").agg(F.count(F.lit(1)).alias("prompts"))


def bag_of_words(text: Column, size: int = 64) -> Column:
    """Stand-in encoder: words counted in ``size`` buckets by their hash, unit length."""
    buckets = F.transform(
        tokens(text), lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint") % size
    )

    every = F.sequence(F.lit(0).cast("bigint"), F.lit(size - 1).cast("bigint"))  # each bucket once, so all are there in order
    return l2_normalize(F.transform(term_counts(F.concat(buckets, every)), lambda b: (b["tf"] - 1).cast("double")))


def word_overlap(query: Column, text: Column) -> Column:
    """Stand-in pair scorer: share of the query's distinct words found in the text."""
    return let(F.array_distinct(tokens(query)), lambda asked: F.coalesce(
        F.try_divide(F.size(F.array_intersect(asked, tokens(text))), F.size(asked)), F.lit(0.0)
    ))


def overlap_answer(query: Column, hits: Column) -> Column:
    """Stand-in ranker: the order by word overlap, written as a model would."""
    scored = F.transform(hits, lambda hit, at: F.struct(
        (-word_overlap(query, hit["text"])).alias("miss"), (at + 1).alias("number")
    ))
    return F.array_join(F.transform(F.sort_array(scored), lambda s: F.concat(
        F.lit("["), s["number"].cast("string"), F.lit("]")
    )), " > ")


def plain_title(query: Column) -> Column:
    """Stand-in title writer: the cleaned query's distinct words."""
    return F.array_join(F.array_distinct(tokens(clean_query(query))), " ")
