"""Nearest neighbours by multi-index hashing.

Vectors become binary codes: centred, rotated to their main axes and by an
iteratively learned rotation, and cut at zero.  A code is split into substrings
of 16 bits, each with an index of its own.  Two codes that differ in at most r
bits agree up to r // m bits in at least one of m substrings (more exactly, in
one of the first r % m + 1 up to r // m, or in one of the others up to r // m - 1);
so probing those neighbours of each substring finds every code within radius r.
What is found is ranked anew by the inner products of the vectors themselves.

The rotation and the radius are learned on a bounded sample; every row is
indexed.  Rows are dealt out once, in shards of bounded size, each with an index
that is built once; the queries, written in files of bounded size, are read by
every task one file after another.  Only a task's best rows per query leave it.
A query that finds too few rows in a shard there reads the whole shard.

To rank by inner product also where lengths differ, a vector gets one more
coordinate that brings it to the length of the longest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftrank.llm.common import named
from siftrank.scratch import materialize, read_shared_parquet, scratch_path

SAMPLE = 4096          # rows that the rotation is learned from
TRIALS = 256           # of them, queries that the radius is measured with
ROUNDS = 30            # of the rotation's improvement
BITS = 64
SUBSTRING = 16
SHARD_ROWS = 1 << 15
BLOCK_QUERIES = 1 << 10
TARGET = 0.97          # share of the nearest sample rows that the radius must reach
CHUNK = 64             # queries ranked together in a task


@dataclass
class Codes:
    """The learned map from vectors to codes, and the probing radius."""
    mean: np.ndarray
    rotation: np.ndarray
    longest: float
    radius: int

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        extra = np.sqrt(np.maximum(self.longest ** 2 - (vectors ** 2).sum(axis=1), 0))
        return np.concatenate([vectors, extra[:, None]], axis=1)

    def encode(self, vectors: np.ndarray, query: bool = False) -> np.ndarray:
        """Codes as rows of 16-bit substrings.  A query's direction is what counts, so it is stretched, not lifted."""
        if query:
            length = np.linalg.norm(vectors, axis=1, keepdims=True)
            rows = np.concatenate([vectors / length * self.longest, np.zeros((len(vectors), 1))], axis=1)
        else:
            rows = self.lifted(vectors)
        bits = (rows - self.mean) @ self.rotation > 0
        return np.packbits(bits, axis=1).view(">u2").astype(np.uint16)


def learn(sample: np.ndarray, longest: float, k: int, bits: int = BITS, seed: int = 0) -> Codes:
    """Rotation by alternating between codes and the best orthogonal map, then the least radius that reaches the target."""
    chance = np.random.default_rng(seed)
    codes = Codes(np.zeros(sample.shape[1] + 1), np.zeros((sample.shape[1] + 1, bits)), longest, 0)
    rows = codes.lifted(sample)
    codes.mean = rows.mean(axis=0)
    rows = rows - codes.mean
    _, _, axes = np.linalg.svd(rows, full_matrices=True)
    axes = axes[:bits].T  # of fewer dimensions than bits, several random rotations follow one another
    parts = []
    for first in range(0, bits, axes.shape[1]):
        width = min(axes.shape[1], bits - first)
        own = axes[:, :width]
        flat = rows @ own
        turn, _ = np.linalg.qr(chance.normal(size=(width, width)))
        for _ in range(ROUNDS):
            signs = np.where(flat @ turn > 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(signs.T @ flat)
            turn = (left @ right).T
        parts.append(own @ turn)
    codes.rotation = np.concatenate(parts, axis=1)
    tried = sample[chance.permutation(len(sample))[:TRIALS]]
    exact = np.argsort(-(tried @ sample.T), axis=1, kind="stable")[:, 1:k + 1]
    far = distances(codes.encode(tried, query=True), codes.encode(sample))
    wanted = np.sort(np.take_along_axis(far, exact, axis=1).reshape(-1))
    codes.radius = int(wanted[min(len(wanted) - 1, int(np.ceil(TARGET * len(wanted))))]) if len(wanted) else bits
    return codes


def distances(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Bits in which each query's code differs from each row's."""
    return sum(np.bitwise_count(queries[:, None, j] ^ rows[None, :, j]).astype(np.int16) for j in range(rows.shape[1]))


class Shard:
    """Codes of a shard's rows, with an index of every substring: rows ordered by its value."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes
        self.orders = [np.argsort(codes[:, j], kind="stable") for j in range(codes.shape[1])]
        self.starts = [np.searchsorted(codes[o, j], np.arange((1 << SUBSTRING) + 1)) for j, o in enumerate(self.orders)]

    def within(self, query: np.ndarray, radius: int) -> np.ndarray:
        """All rows whose code differs from the query's in at most ``radius`` bits."""
        m = self.codes.shape[1]
        near, wide = divmod(radius, m)
        found = []
        for j in range(m):
            reach = near if j <= wide else near - 1
            if reach < 0:
                continue
            values = query[j] ^ neighbourhood(reach)
            low, high = self.starts[j][values], self.starts[j][values.astype(np.int64) + 1]
            size = high - low
            keep = size > 0
            low, size = low[keep], size[keep]
            if len(size):
                step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                found.append(self.orders[j][np.repeat(low, size) + step])
        if not found:
            return np.zeros(0, dtype=np.int64)
        mark = np.zeros(len(self.codes), dtype=bool)
        for rows in found:
            mark[rows] = True
        rows = np.flatnonzero(mark)
        far = np.bitwise_count(self.codes[rows] ^ query[None, :]).sum(axis=1)
        return rows[far <= radius]


_MASKS: dict[int, np.ndarray] = {}


def neighbourhood(reach: int) -> np.ndarray:
    """All 16-bit values with at most ``reach`` bits set."""
    reach = min(reach, SUBSTRING)
    if reach not in _MASKS:
        values = np.arange(1 << SUBSTRING, dtype=np.uint32).astype(np.uint16)
        _MASKS[reach] = values[np.bitwise_count(values) <= reach]
    return _MASKS[reach]


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, v): rows with a vector that is not null or zero and has finite components only, as doubles.

    Vectors of another length than the most frequent one (of equally frequent
    ones the longest) take no part either, as no inner product is defined.
    """
    v = named(vectors, embedding)
    rows = vectors.select(named(vectors, vec_id).cast("long").alias("id"), F.transform(v, lambda x: x.cast("double")).alias("v"))
    good = F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall(
        "v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.filter(F.coalesce(good, F.lit(False)))
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.filter(F.size("v") == (length["n"] if length else 0))


def query_chunks(asked: DataFrame) -> list[str]:
    """The queries, written once to the shared folder in files of about ``BLOCK_QUERIES``."""
    path = scratch_path(asked.sparkSession, "search_queries")
    asked = materialize(asked, "search_asked")
    asked.repartition(max(1, -(-asked.count() // BLOCK_QUERIES))).write.parquet(path)
    return sorted(asked.sparkSession.read.schema(asked.schema).parquet(path).inputFiles())


def nearest(vectors: DataFrame, queries: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding",
            shard_rows: int = SHARD_ROWS, radius: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row that ``queries`` selects, its ``k`` nearest other rows.

    ``queries`` is a condition on the column ``id``.  Nearest is the largest
    inner product in double precision, ties go to the smaller id.  Rows that
    repeat an id are all candidates but for the query's own id, and a repeated
    query is asked once.  An empty table gives no rows.
    """
    rows = materialize(usable(vectors, vec_id, embedding), "search_rows")
    n = rows.count()
    out = "query_id long, rank int, vec_id long, score double"
    if not n:
        return rows.sparkSession.createDataFrame([], out)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    longest = rows.agg(F.max(norm)).first()[0]
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    codes = learn(np.array([r["v"] for r in sample]), longest, k)
    if radius is not None:
        codes.radius = radius
    asked = rows.filter(queries).dropDuplicates(["id"])
    chunks = query_chunks(asked)
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // shard_rows))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def shard_hits() -> Iterator[pd.DataFrame]:
            have = pd.concat(held, ignore_index=True)
            held.clear()
            ids = have["id"].to_numpy()
            order = np.argsort(ids, kind="stable")  # so that equal scores come in order of the ids
            ids, base = ids[order], np.stack(have["v"].to_numpy()[order])
            shard = Shard(codes.encode(base))  # the index is built once and serves all queries
            for chunk in chunks:
                ask = read_shared_parquet(chunk)
                wanted = np.stack(ask["v"].to_numpy()) if len(ask) else np.zeros((0, base.shape[1]))
                found: list[tuple[np.ndarray, ...]] = []
                for query, vector, mark in zip(ask["id"].tolist(), wanted, codes.encode(wanted, query=True)):
                    near = shard.within(mark, codes.radius)
                    near = near[ids[near] != query]
                    if len(near) < k:
                        near = np.flatnonzero(ids != query)
                    score = np.einsum("ij,j->i", base[near], vector)
                    best = np.argsort(-score, kind="stable")[:k]
                    found.append((np.full(len(best), query), ids[near[best]], score[best]))
                if found:
                    first, second, third = (np.concatenate(c) for c in zip(*found))
                    yield pd.DataFrame({"query_id": first, "vec_id": second, "score": third.astype("float64")})

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= shard_rows:
                yield from shard_hits()
        if sum(map(len, held)):
            yield from shard_hits()

    met = rows.repartition(tasks).mapInPandas(search, "query_id long, vec_id long, score double")
    line = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(line)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def brute_force(ids: np.ndarray, vectors: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, list[int]]]:
    """The true neighbours, to measure recall with."""
    for at in range(0, len(queries), CHUNK):
        own = queries[at:at + CHUNK]
        scores = vectors[own] @ vectors.T
        scores[np.arange(len(own)), own] = -np.inf
        for i, line in zip(own.tolist(), scores):
            best = np.lexsort((ids, -line))[:k]
            yield int(ids[i]), ids[best].tolist()
