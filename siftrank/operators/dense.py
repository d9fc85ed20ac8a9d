"""Cosine nearest neighbours for a table of query vectors."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftrank.functions.vectors import dot, l2_normalize
from siftrank.operators.ranking import top_n
from siftrank.scratch import (
    PART_BYTES, fan_out, materialize, measure, read_bytes, read_shared_batches, scratch_path, spread,
)

CHUNK_BYTES = 2 << 20    # written vectors that a task reads at a time
FILE_BYTES = 16 << 20    # of them in a file
BLOCK_BYTES = 32 << 20   # vectors that a task holds while it reads others
SCORE_CELLS = 1 << 18    # scores held at once: queries times products
PRODUCTS_AT_ONCE = 4096  # products that are compared before the bars rise
HITS_PER_TASK = 1 << 20  # hits that a task holds: queries times k
CANDIDATES_AT_ONCE = 1 << 16  # candidates whose vectors are gathered
ROUNDED = 2.1e-6         # of a cosine: what rounding its score to six digits can hide
SAMPLE_ROWS = 16_384     # vectors that code books are trained on
SAMPLE_PER_CELL = 64     # vectors per cell that cells are trained on
MOST_CELLS = 4096        # trained cells by default; they are sent to every task
ROUNDS = 12              # of k-means
CODES = 256              # centres of a part of the vectors: a byte


def _unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of unit length, and which rows are not zero."""
    matrix = np.asarray(vectors, dtype=np.float64)
    norms = np.sqrt((matrix * matrix).sum(axis=1))
    known = norms > 0
    return matrix[known] / norms[known][:, None], known


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 0))


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's ``k`` best scores; on ties the first columns."""
    if scores.shape[1] > k:
        limit = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
        rows, columns = np.nonzero(scores >= limit[:, None])
    else:
        rows, columns = (places.ravel() for places in np.indices(scores.shape))
    order = np.lexsort((columns, -scores[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    starts = np.searchsorted(rows, np.arange(scores.shape[0]))
    keep = np.arange(len(rows)) - starts[rows] < k
    return rows[keep], columns[keep]


class _Best:
    """The ``k`` best products so far for each of a block of queries; on equal scores the smaller product ids."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.size = k, queries
        self.bar = np.full(queries, -np.inf)  # a query's k-th best score
        self.held: list[tuple[np.ndarray, np.ndarray, pd.DataFrame]] = []
        self.waiting = 0

    def add(self, rows: np.ndarray, scores: np.ndarray, products: pd.DataFrame) -> None:
        if len(rows):
            self.held.append((rows, scores, products))
            self.waiting += len(rows)
            if self.waiting >= self.size * self.k:
                self.merge()

    def merge(self) -> None:
        if not self.waiting:
            return
        rows = np.concatenate([h[0] for h in self.held])
        scores = np.concatenate([h[1] for h in self.held])
        products = pd.concat([h[2] for h in self.held], ignore_index=True)
        ids, _ = pd.factorize(products["product_id"], sort=True)
        order = np.lexsort((ids, -scores, rows))
        at = rows[order]
        place = np.arange(len(at)) - np.searchsorted(at, np.arange(self.size))[at]
        last = order[place == self.k - 1]
        self.bar[rows[last]] = scores[last]
        order = order[place < self.k]
        self.held = [(rows[order], scores[order], products.iloc[order].reset_index(drop=True))]
        self.waiting = 0

    def found(self, query_ids: np.ndarray) -> pd.DataFrame | None:
        """All products with their query and score; None if there are none."""
        self.merge()
        if not self.held:
            return None
        rows, scores, products = self.held[0]
        return products.assign(query_id=query_ids[rows], score=scores)


def _compare(best: _Best, queries: np.ndarray, products: np.ndarray, shown: pd.DataFrame, rows: np.ndarray | None = None) -> None:
    """Unit vectors of some of the queries (``rows``, or all) against those of some products, in the order of their ids.

    Most products stay below the bar that earlier ones have set, and are left by
    one comparison; a score, the cosine moved to 0..1, is rounded to six digits.
    """
    step = max(1, SCORE_CELLS // max(1, len(products)))
    for start in range(0, len(queries), step):
        own = np.arange(start, min(start + step, len(queries))) if rows is None else rows[start:start + step]
        cosine = queries[start:start + step] @ products.T
        least = 2 * best.bar[own] - 1 - ROUNDED
        near, columns = np.nonzero(cosine >= least[:, None])
        if len(near) > len(own) * best.k:
            near, columns = _best(np.round((1.0 + cosine) / 2.0, 6), best.k)
        scores = np.round((1.0 + cosine[near, columns]) / 2.0, 6)
        best.add(own[near], scores, shown.iloc[columns])


def _hit_schema(vectors: DataFrame, queries: DataFrame) -> T.StructType:
    fields = [f for f in vectors.schema.fields if f.name not in ("embedding", "code", "_cell")]
    return T.StructType([*fields, T.StructField("query_id", queries.schema["query_id"].dataType),
                         T.StructField("score", T.DoubleType())])


@dataclass(frozen=True)
class _Stored:
    """A table written once to the shared folder in files of bounded size, which tasks read some ``rows`` at a time."""

    files: list[str]
    rows: int

    def read(self, files: list[str] | None = None) -> Iterator[pd.DataFrame]:
        for file in self.files if files is None else files:
            yield from read_shared_batches(file, self.rows)


def _store(df: DataFrame, name: str, size: tuple[int, int], chunk_bytes: int = CHUNK_BYTES, order: str | None = None) -> _Stored:
    """``df`` of ``size`` (rows and bytes), read by ``chunk_bytes``; with ``order``, sorted by it over all files."""
    rows, total = size
    files = max(1, -(-total // FILE_BYTES))
    placed = df.repartitionByRange(files, order).sortWithinPartitions(order) if order else df.repartition(files)
    path = scratch_path(df.sparkSession, name)
    placed.write.parquet(path)
    paths = sorted(df.sparkSession.read.schema(df.schema).parquet(path).inputFiles())
    return _Stored(paths, max(1, chunk_bytes * rows // max(1, total)))


Search = Callable[[pd.DataFrame], Iterator[pd.DataFrame]]


def _by_blocks(rows: DataFrame, schema: T.StructType, search: Search, most: int | None = None) -> DataFrame:
    """``search`` of each block of ``BLOCK_BYTES``, and of ``most`` rows, that a task holds; the rows stay where they are."""
    names = schema.fieldNames()
    data = next(c for c in ("embedding", "code") if c in rows.columns)
    item = 1 if data == "code" else 8

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        count = 0

        def block() -> Iterator[pd.DataFrame]:
            for found in search(pd.concat(held, ignore_index=True)):
                yield found[names]

        for batch in batches:
            width = item * max((len(v) for v in batch[data][:1]), default=1)
            room = max(1, min(BLOCK_BYTES // max(1, width), most or len(batch) or 1))
            while len(batch):
                part, batch = batch[:room - count], batch[room - count:]
                held.append(part)
                count += len(part)
                if count >= room:
                    yield from block()
                    held, count = [], 0
        if held:
            yield from block()

    return rows.mapInPandas(run, schema)


def _queries_stay(wanted: tuple[int, int], vectors: DataFrame, chunk_bytes: int) -> tuple[int, int] | None:
    """Size of the products if there are no more bytes of them than of the queries: then the products are what is sent around.

    Otherwise each task with products would give hits for every query, and what
    is shuffled would grow with the product of both.
    """
    if wanted[1] <= min(chunk_bytes, CHUNK_BYTES):
        return None
    size = measure(vectors)
    return size if size[1] <= 2 * wanted[1] else None


def knn(vectors: DataFrame, queries: DataFrame, k: int, *, filter_source: str | None = None,
        filter_mode: str = "post", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Top ``k`` products per query vector: ``query_id, product_id, source, score, rank``.

    ``vectors`` has ``product_id, source, embedding``, ``queries`` has
    ``query_id, embedding`` and may have ``filter_source`` per query.  In post
    mode the filter removes hits from the top ``k``, so fewer can remain; pre
    mode searches the wanted source only.  Vectors of length zero have no
    cosine and take no part.  The same exact plan serves any number of queries.
    """
    if filter_mode not in ("post", "pre"):
        raise ValueError("filter_mode must be 'post' or 'pre'")
    if filter_source and filter_mode == "pre":
        vectors = vectors.filter(F.col("source") == filter_source)
    searched, wanted = vectors.select("product_id", "source", "embedding"), queries.select("query_id", "embedding")
    schema = _hit_schema(searched, queries)
    asked = measure(wanted)
    products = _queries_stay(asked, searched, chunk_bytes)
    if products:
        stored = _store(searched, "products", products, chunk_bytes, "product_id")

        def nearest(own: pd.DataFrame) -> Iterator[pd.DataFrame]:
            unit, known = _unit(_matrix(own["embedding"]))
            best = _Best(len(unit), k)
            for chunk in stored.read():
                vectors, there = _unit(_matrix(chunk["embedding"]))
                _compare(best, unit, vectors, chunk.loc[there, ["product_id", "source"]])
            yield from _some(best.found(own["query_id"].to_numpy()[known]))

        found = _by_blocks(fan_out(wanted, "query_id"), schema, nearest, max(1, HITS_PER_TASK // k))
    else:
        stored = _store(wanted, "query-chunks", asked, chunk_bytes)

        def block(own: pd.DataFrame) -> Iterator[pd.DataFrame]:
            own = own.sort_values("product_id", kind="stable")
            vectors, there = _unit(_matrix(own["embedding"]))
            shown = own.loc[there, ["product_id", "source"]].reset_index(drop=True)
            for chunk in stored.read():
                unit, known = _unit(_matrix(chunk["embedding"]))
                best = _Best(len(unit), k)
                for at in range(0, len(vectors), PRODUCTS_AT_ONCE):
                    _compare(best, unit, vectors[at:at + PRODUCTS_AT_ONCE], shown[at:at + PRODUCTS_AT_ONCE])
                yield from _some(best.found(chunk["query_id"].to_numpy()[known]))

        found = _by_blocks(spread(searched), schema, block)
    hits = top_n(found, ["query_id"], [F.desc("score"), F.asc("product_id")], k)
    if filter_source and filter_mode == "post":
        hits = hits.filter(F.col("source") == filter_source)
    if "filter_source" in queries.columns:
        wanted = queries.select("query_id", "filter_source")
        hits = hits.join(wanted, "query_id").filter(
            F.col("filter_source").isNull() | (F.col("filter_source") == F.col("source"))
        ).drop("filter_source")
    return hits.select("query_id", "product_id", "source", "score", "rank")


def _some(found: pd.DataFrame | None) -> Iterator[pd.DataFrame]:
    if found is not None:
        yield found


def assign_cells(rows: DataFrame, centers: np.ndarray, probes: int) -> DataFrame:
    """The ``probes`` nearest cells of each row, one output row per cell."""
    shared = rows.sparkSession.sparkContext.broadcast(_unit(centers)[0])
    schema = T.StructType([*rows.schema.fields, T.StructField("_cell", T.LongType())])

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            unit, known = _unit(_matrix(batch["embedding"]))
            batch = batch[known].reset_index(drop=True)
            if len(batch):
                at, cell = _best(unit @ shared.value.T, probes)
                out = batch.iloc[at].reset_index(drop=True)
                out["_cell"] = cell.astype("int64")
                yield out

    return rows.mapInPandas(nearest, schema)


def sampled(vectors: DataFrame, rows: int, seed: int = 42) -> DataFrame:
    """About ``rows`` of the vectors, chosen by a hash of their ids; all if there are not more."""
    total = vectors.count()
    if total <= rows:
        return vectors
    steps = 1 << 30
    return vectors.filter(F.pmod(F.xxhash64(F.lit(seed), "product_id"), F.lit(steps)) < math.ceil(steps * rows / total))


def trained_centers(vectors: DataFrame, cells: int | None = None, seed: int = 42) -> np.ndarray:
    """Centres of Spark's KMeans over a sample of ``SAMPLE_PER_CELL`` vectors per cell.

    By default there are as many as the root of the number of vectors, up to
    ``MOST_CELLS``; beyond that the cells grow, and are searched in more blocks.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    cells = cells or min(max(2, math.isqrt(vectors.count())), MOST_CELLS)
    own = sampled(vectors.select("product_id", "embedding"), SAMPLE_PER_CELL * cells, seed)
    features = materialize(own.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features")), "sample")
    return np.array(KMeans(k=cells, seed=seed, maxIter=10).fit(features).clusterCenters())  # cells x dimension


def knn_cells(vectors: DataFrame, queries: DataFrame, k: int, *, centers: np.ndarray | None = None,
              cells: int | None = None, probes: int = 4, seed: int = 42, rows_per_block: int = 20000) -> DataFrame:
    """Approximate search: each query is compared with the vectors of its ``probes`` nearest cells.

    Cells are those of ``centers``, else trained.  The vectors are written once,
    in files of one cell each; the queries stay where they are, and a task reads
    the cells that its queries probe, ``rows_per_block`` vectors at a time.  So
    neither vectors nor queries are copied, and no more than ``k`` hits of a query
    leave a task, whatever the size of a cell.
    """
    if centers is None:
        centers = trained_centers(vectors, cells, seed)
    searched, wanted = vectors.select("product_id", "source", "embedding"), queries.select("query_id", "embedding")
    files = _cell_files(assign_cells(searched, centers, 1))
    shared = vectors.sparkSession.sparkContext.broadcast(_unit(centers)[0])

    def nearest(own: pd.DataFrame) -> Iterator[pd.DataFrame]:
        unit, known = _unit(_matrix(own["embedding"]))
        best = _Best(len(unit), k)
        at, cell = _best(unit @ shared.value.T, probes) if len(unit) else (np.zeros(0, int), np.zeros(0, int))
        order = np.argsort(cell, kind="stable")
        at, cell = at[order], cell[order]
        for probed in np.unique(cell).tolist():
            rows = at[np.searchsorted(cell, probed):np.searchsorted(cell, probed, "right")]
            asked = unit[rows]
            for chunk in _Stored(files.get(probed, []), rows_per_block).read():
                vectors, _ = _unit(_matrix(chunk["embedding"]))
                _compare(best, asked, vectors, chunk[["product_id", "source"]], rows)
        yield from _some(best.found(own["query_id"].to_numpy()[known]))

    found = _by_blocks(fan_out(wanted, "query_id"), _hit_schema(searched, queries), nearest, max(1, HITS_PER_TASK // k))
    return top_n(found, ["query_id"], [F.desc("score"), F.asc("product_id")], k).select(
        "query_id", "product_id", "source", "score", "rank"
    )


def _cell_files(placed: DataFrame) -> dict[int, list[str]]:
    """Rows written once in folders of their ``_cell``, ordered by product inside; the files of each cell in that order."""
    spark = placed.sparkSession
    path = scratch_path(spark, "cells")
    parts = max(spark.sparkContext.defaultParallelism, read_bytes(placed) // PART_BYTES)
    placed = materialize(placed, "placed")  # the bounds of the ranges need a pass of their own
    placed.repartitionByRange(parts, "_cell", "product_id").sortWithinPartitions("_cell", "product_id").write.partitionBy(
        "_cell").parquet(path)
    files: dict[int, list[str]] = {}
    for file in sorted(spark.read.schema(placed.schema).parquet(path).inputFiles()):
        files.setdefault(int(file.rsplit("/_cell=", 1)[1].split("/")[0]), []).append(file)
    return files


@dataclass(frozen=True)
class CodeBook:
    """Centres of the parts of a rotated unit vector; a vector's code is the nearest centre of each part, a byte each."""

    turn: np.ndarray     # dimension x dimension, orthogonal
    centers: np.ndarray  # parts x CODES x dimension of a part

    @property
    def parts(self) -> int:
        return len(self.centers)

    def split(self, unit: np.ndarray) -> np.ndarray:
        return (unit @ self.turn).reshape(len(unit), self.parts, -1).transpose(1, 0, 2)

    def encode(self, unit: np.ndarray) -> np.ndarray:
        return np.stack([_nearest(part, own) for part, own in zip(self.split(unit), self.centers)], axis=1).astype(np.uint8)

    def scores(self, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Inner products of queries and coded vectors, looked up in one table per part."""
        total = np.zeros((len(codes), len(queries)), dtype=np.float32)
        for part, own, code in zip(self.split(queries), self.centers, codes.T):
            total += (own @ part.T).astype(np.float32)[code]
        return total.T


def _nearest(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    half = 0.5 * (centers * centers).sum(axis=1)
    return np.concatenate([(rows[at:at + 4096] @ centers.T - half).argmax(axis=1) for at in range(0, max(len(rows), 1), 4096)])


def train_codes(vectors: DataFrame, parts: int | None = None, rows: int = SAMPLE_ROWS, seed: int = 42) -> CodeBook:
    """Code book of a sample of about ``rows`` vectors; by default a byte for four components.

    A rotation by the sample's principal axes, dealt out in turn, gives all parts
    about the same share of the variance.
    """
    own = sampled(vectors.select("product_id", "embedding"), rows, seed).select("embedding").toPandas()  # a bounded sample
    unit, _ = _unit(_matrix(own["embedding"]))
    if not len(unit):
        raise ValueError("no vector of a length above zero to train on")
    dims = unit.shape[1]
    parts = parts or max(p for p in range(1, dims + 1) if dims % p == 0 and p <= max(1, dims // 4))
    if dims % parts:
        raise ValueError(f"{dims} components do not fall into {parts} equal parts")
    centred = unit - unit.mean(axis=0)
    _, axes = np.linalg.eigh(centred.T @ centred)
    turn = axes[:, ::-1].reshape(dims, -1, parts).transpose(0, 2, 1).reshape(dims, dims)
    rng = np.random.default_rng(seed)
    centers = []
    for part in (unit @ turn).reshape(len(unit), parts, -1).transpose(1, 0, 2):
        now = part[rng.choice(len(part), CODES, replace=len(part) < CODES)]
        for _ in range(ROUNDS):
            at = _nearest(part, now)
            counts = np.bincount(at, minlength=CODES)
            sums = np.stack([np.bincount(at, part[:, j], CODES) for j in range(part.shape[1])], axis=1)
            empty = counts == 0
            now = np.where(empty[:, None], part[rng.choice(len(part), CODES)], sums / np.maximum(counts, 1)[:, None])
        centers.append(now)
    return CodeBook(turn, np.stack(centers))


def code_table(vectors: DataFrame, book: CodeBook) -> DataFrame:
    """product_id, source, code of all vectors but those of length zero: ``book.parts`` bytes for a vector."""
    rows = vectors.select("product_id", "source", "embedding")
    kept = T.StructType([f for f in rows.schema.fields if f.name != "embedding"] + [T.StructField("code", T.BinaryType())])
    shared = rows.sparkSession.sparkContext.broadcast(book)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                unit, known = _unit(_matrix(batch["embedding"]))
                out = batch.loc[known, ["product_id", "source"]].reset_index(drop=True)
                out["code"] = [c.tobytes() for c in shared.value.encode(unit)]
                yield out

    return rows.mapInPandas(encode, kept)


def knn_codes(codes: DataFrame, book: CodeBook, vectors: DataFrame, queries: DataFrame, k: int, *, pool: int | None = None,
              chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Approximate ``knn``: all codes are scanned, and the best ``pool`` (20 k) of a query are ranked by their vectors.

    A scan reads ``book.parts`` bytes for a vector instead of the vector.  For few
    queries the vectors are read for the candidates only; if there are as many
    bytes of queries as of vectors, every vector is some query's candidate, and
    each task reads codes and vectors through for the queries that it holds, so
    candidates are never shuffled.  Scores are exact.
    """
    pool = pool or 20 * k
    schema = _hit_schema(codes, queries)
    shared = codes.sparkSession.sparkContext.broadcast(book)
    wanted = queries.select("query_id", "embedding")
    asked = measure(wanted)
    own_vectors = vectors.select("product_id", "embedding")
    size = _queries_stay(asked, own_vectors, chunk_bytes)

    def scanned(best: _Best, unit: np.ndarray, products: pd.DataFrame) -> None:
        """Codes of products, in the order of their ids, against the queries."""
        matrix = np.frombuffer(b"".join(products["code"]), dtype=np.uint8).reshape(len(products), -1)
        step = max(1, SCORE_CELLS // max(1, len(matrix)))
        for start in range(0, len(unit), step):
            scores = shared.value.scores(unit[start:start + step], matrix)
            rows, columns = np.nonzero(scores >= best.bar[start:start + step, None])
            if len(rows) > len(scores) * pool:
                rows, columns = _best(scores, pool)
            best.add(start + rows, scores[rows, columns].astype(np.float64), products[["product_id", "source"]].iloc[columns])

    if size:
        stored_codes = _store(codes.select("product_id", "source", "code"), "codes", measure(codes), order="product_id")
        stored = _store(own_vectors, "products", size, order="product_id")

        def nearest(own: pd.DataFrame) -> Iterator[pd.DataFrame]:
            unit, known = _unit(_matrix(own["embedding"]))
            best = _Best(len(unit), pool)
            for chunk in stored_codes.read():
                for at in range(0, len(chunk), PRODUCTS_AT_ONCE):
                    scanned(best, unit, chunk[at:at + PRODUCTS_AT_ONCE])
            best.merge()
            if not best.held:
                return
            rows, _, near = best.held[0]
            order = np.argsort(near["product_id"].to_numpy(), kind="stable")
            rows, near = rows[order], near.iloc[order].reset_index(drop=True)
            ids, exact = near["product_id"].to_numpy(), np.full(len(rows), np.nan)
            for chunk in stored.read():
                there = chunk["product_id"].to_numpy()
                vectors, some = _unit(_matrix(chunk["embedding"]))
                there = there[some]
                if not len(there):
                    continue
                low, high = np.searchsorted(ids, there[0]), np.searchsorted(ids, there[-1], "right")
                for at in range(low, high, CANDIDATES_AT_ONCE):
                    part = slice(at, min(at + CANDIDATES_AT_ONCE, high))
                    place = np.minimum(np.searchsorted(there, ids[part]), len(there) - 1)
                    score = np.round((1 + np.einsum("ij,ij->i", unit[rows[part]], vectors[place])) / 2, 6)
                    exact[part] = np.where(there[place] == ids[part], score, exact[part])
            reached = ~np.isnan(exact)  # a code may have no vector
            top = _Best(len(unit), k)
            top.add(rows[reached], exact[reached], near[reached])
            yield from _some(top.found(own["query_id"].to_numpy()[known]))

        found = _by_blocks(fan_out(wanted, "query_id"), schema, nearest, max(1, HITS_PER_TASK // pool))
        return top_n(found, ["query_id"], [F.desc("score"), F.asc("product_id")], k).select(
            "query_id", "product_id", "source", "score", "rank")

    stored = _store(wanted, "query-chunks", asked, chunk_bytes)

    def block(products: pd.DataFrame) -> Iterator[pd.DataFrame]:
        products = products.sort_values("product_id", kind="stable")
        for chunk in stored.read():
            unit, known = _unit(_matrix(chunk["embedding"]))
            ids = chunk["query_id"].to_numpy()[known]
            step = max(1, HITS_PER_TASK // pool)
            for start in range(0, len(unit), step):
                best = _Best(len(unit[start:start + step]), pool)
                for at in range(0, len(products), PRODUCTS_AT_ONCE):
                    scanned(best, unit[start:start + step], products[at:at + PRODUCTS_AT_ONCE])
                yield from _some(best.found(ids[start:start + step]))

    near = top_n(_by_blocks(codes, schema, block), ["query_id"], [F.desc("score"), F.asc("product_id")], pool)
    near = materialize(near.select("query_id", "product_id", "source"), "near")
    asked_units = queries.select("query_id", l2_normalize(F.col("embedding")).alias("_query"))
    units = vectors.select("product_id", l2_normalize(F.col("embedding")).alias("_vector"))
    score = F.round((1 + dot(F.col("_query"), F.col("_vector"))) / 2, 6).alias("score")
    scored = near.join(units, "product_id").join(asked_units, "query_id").select("query_id", "product_id", "source", score)
    return top_n(scored, ["query_id"], [F.desc("score"), F.asc("product_id")], k)
