"""Near duplicates by a grouped prefix join on word shingles.

Shingles are ordered by how often their bucket occurs in all documents, then
by hash, rare ones first.  Two sets with a similarity of at least 3/4 share a
shingle among the first quarter of each (the prefix).  Documents with the same
prefix and size are one group and are listed once under each prefix shingle.
Group pairs that meet under a shingle and pass the size and position filters
are expanded to members, whose whole sets are compared.

Links are wanted, not all pairs: first only some neighbours in each list are
compared (and each list's first of its size class with all others), which
joins most of what belongs together; then every remaining pair that meets in a
list and is in two different components is compared.  A pair inside a component
could not change it.  So no list is expanded to all its pairs and no link
between components is lost.  Equal sets are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftrank.llm.common import bound_batches, list_of, named, packed_texts, row_groups, text_bytes, tidy, whole_text, wider, worker_state
from siftrank.llm.components import components
from siftrank.llm.shingles import Shingler
from siftrank.scratch import materialize, remove_folders, settled, tagged_folders

BUCKET_BITS = 20       # shingles are counted in 2**20 buckets, whatever the input
GROUP_BYTES = 1 << 19  # texts that are shingled together
NEIGHBOURS = (1, 2, 4, 8, 16, 32, 64)  # places before a document in a list that it is compared with first
MERGE = 64             # partial counts added up by one task


def prefix_size(n: int) -> int:
    """Shingles of a set among which one is shared with any set of similarity 3/4 or more."""
    return n - (3 * n + 3) // 4 + 1


def shingle_groups(batch: pa.RecordBatch, column: int) -> Iterator[np.ndarray]:
    """The sorted set of every text of a batch."""
    shingler = worker_state("shingler", Shingler)
    data, offsets = text_bytes(batch.column(column))
    for a, b in row_groups(offsets, GROUP_BYTES):
        yield from shingler.sets(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Occurrences of each bucket of shingles over all documents: an array of fixed size.

    Every task counts its own documents; the arrays are added up in slices, at
    most ``MERGE`` of them in one task at a time.
    """
    size, slices = 1 << BUCKET_BITS, 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            held: list[np.ndarray] = []
            for own in shingle_groups(batch, 0):
                held.append(own >> np.uint64(64 - BUCKET_BITS))
                if len(held) == 1000:
                    total += np.bincount(np.concatenate(held).astype(np.int64), minlength=size)
                    held = []
            if held:
                total += np.bincount(np.concatenate(held).astype(np.int64), minlength=size)
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * slices, pa.int64()), pa.array(range(slices), pa.int64()),
             pa.array([s.tobytes() for s in total.reshape(slices, -1)], pa.binary())], names=["part", "slice", "counts"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(raw, dtype=np.int64) for raw in rows["counts"])
        return pd.DataFrame({"part": [rows["part"].iloc[0] // MERGE], "slice": [rows["slice"].iloc[0]], "counts": [total.tobytes()]})

    schema = "part long, slice long, counts binary"
    rows = texts.mapInArrow(tidy(count), schema)
    parts = texts.rdd.getNumPartitions()
    while parts > 1:
        rows = rows.groupBy("slice", F.floor(F.col("part") / MERGE)).applyInPandas(add, schema)
        parts = -(-parts // MERGE)
    out = np.zeros((slices, size // slices), dtype=np.int64)
    for row in rows.collect():  # 64 rows, 8 MB
        out[row["slice"]] += np.frombuffer(row["counts"], dtype=np.int64)
    return out.reshape(-1)


def signatures(rows: DataFrame, counts: np.ndarray) -> DataFrame:
    """(doc_id, t1, t2, n, s1, s2, gid, prefix) per document.

    t1, t2 identify the text, s1, s2 the set, gid its group (size and prefix).
    The prefix is given once per group and task, else null.
    """
    rank = np.minimum(counts, np.iinfo(np.int32).max).astype(np.int32)
    shared = rows.sparkSession.sparkContext.broadcast(rank)  # 4 MB, whatever the input

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        order = shared.value
        seen: set[int] = set()
        for batch in batches:
            n, first, second, group, prefixes, ends = [], [], [], [], [], [0]
            for own in shingle_groups(batch, batch.num_columns - 1):
                raw = own.tobytes()
                digest = xxhash.xxh3_128_intdigest(raw)
                size = len(own)
                count = order[(own >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
                prefix = own[np.argsort(count, kind="stable")[:prefix_size(size)]] if size else own
                gid = xxhash.xxh3_64_intdigest(prefix.tobytes(), seed=size)
                n.append(size)
                first.append(digest >> 64)
                second.append(digest & (2**64 - 1))
                group.append(gid)
                if size and gid not in seen:
                    seen.add(gid)
                    prefixes.append(prefix)
                ends.append(ends[-1] + (len(prefix) if prefixes and prefixes[-1] is prefix else 0))
            signed = lambda values: pa.array(np.array(values, dtype=np.uint64).view(np.int64), pa.int64())
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(n, pa.int64()), signed(first), signed(second), signed(group),
                 list_of(flat.view(np.int64), np.array(ends), pa.int64())],
                names=[*batch.schema.names[:-1], "n", "s1", "s2", "gid", "prefix"])

    return rows.mapInArrow(tidy(sign), wider(rows.drop("text"), n="long", s1="long", s2="long", gid="long", prefix="array<bigint>"))


def compatible(n: str, m: str, i: str, j: str) -> Column:
    """Size and position filters for sets of n <= m shingles that meet at positions i and j of their prefixes."""
    n, m, i, j = F.col(n), F.col(m), F.col(i), F.col(j)
    needed = F.floor((3 * (n + m) + 6) / 7)
    return (4 * n >= 3 * m) & (i < n - F.floor((6 * n + 6) / 7) + 1) & (F.least(n - i, m - j) >= needed)


def verify(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets have a similarity of 3/4 or more."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpacker, shingler = zstandard.ZstdDecompressor(), worker_state("shingler", Shingler)
        known: dict[int, np.ndarray] = {}

        def fill(nodes_: list[int], packed: pa.Array) -> None:
            """Sets of nodes that are not known, many texts at a time."""
            names, parts, size = [], [], 0

            def flush() -> None:
                offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
                data = np.frombuffer(b"".join(parts), dtype=np.uint8)
                known.update(zip(names, shingler.sets(data, offsets)))

            wanted = set()
            for i, node in enumerate(nodes_):
                if node not in known and node not in wanted:
                    wanted.add(node)
                    names.append(node)
                    parts.append(unpacker.decompress(packed[i].as_py()))
                    size += len(parts[-1])
                    if size >= GROUP_BYTES:
                        flush()
                        names, parts, size = [], [], 0
            if parts:
                flush()

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                a, b = some.column(0).to_pylist(), some.column(1).to_pylist()
                if sum(len(s) for s in known.values()) > 1 << 21:
                    known.clear()
                fill(a, some.column(2))
                fill(b, some.column(3))
                good = []
                for x, y in zip(a, b):
                    first, second = known[x], known[y]
                    both = len(np.intersect1d(first, second, assume_unique=True))
                    good.append(100 * both >= 75 * (len(first) + len(second) - both))
                keep = pa.array(good, pa.bool_())
                yield pa.RecordBatch.from_arrays([some.column(0).filter(keep), some.column(1).filter(keep)], names=["u", "v"])

    keys = nodes.select("node", "t1", "t2")
    wanted = pairs.join(keys.withColumnsRenamed({"node": "a", "t1": "a1", "t2": "a2"}), "a").join(
        keys.withColumnsRenamed({"node": "b", "t1": "b1", "t2": "b2"}), "b")
    left = texts.withColumnsRenamed({"t1": "a1", "t2": "a2", "packed": "left"}).dropDuplicates(["a1", "a2"])
    right = texts.withColumnsRenamed({"t1": "b1", "t2": "b2", "packed": "right"}).dropDuplicates(["b1", "b2"])
    whole = wanted.join(left, ["a1", "a2"]).join(right, ["b1", "b2"]).select("a", "b", "left", "right")
    return whole.mapInArrow(tidy(compare), "u long, v long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) per row: the smallest doc_id that links reach.

    A text without words has no shingles and is linked with nothing, not even
    an equal one; it is its own component.  Repeated rows come back repeated.  A
    null doc_id is never a component id unless the component has no other.
    """
    bound_batches(docs)
    body = whole_text(named(docs, text))
    rows = docs.select(named(docs, doc_id).cast("long").alias("doc_id"), F.xxhash64(body).alias("t1"),
                       F.xxhash64(F.lit(1), body).alias("t2"), body.alias("text"))
    counts = bucket_counts(rows.select("text"))
    with tagged_folders() as prefixes:  # a large table, of which few columns are read beyond the lists
        signed = materialize(signatures(rows, counts), "shingle_prefixes")

    # Nodes: one per distinct set.  Its name is the smallest text key's hash with the set's, which is unique.
    filled = signed.filter("n > 0")
    nodes = filled.groupBy("s1", "s2", "n").agg(F.min(F.struct("t1", "t2")).alias("t"), F.min("gid").alias("gid"),
                                                F.min("doc_id").alias("first"))
    nodes = materialize(nodes.select(F.xxhash64("s1", "s2", "n").alias("node"), "s1", "s2", "n", "gid", "first",
                                     F.col("t.t1").alias("t1"), F.col("t.t2").alias("t2")), "shingle_nodes")
    groups = nodes.groupBy("gid").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("members"), F.min("n").alias("n"))
    groups = materialize(groups, "shingle_groups")

    # Lists: token, group, position; those with one group only are dropped.
    listed = filled.filter(F.size("prefix") > 0).select("gid", "n", F.posexplode("prefix").alias("pos", "token"))
    listed = listed.repartition("token").dropDuplicates(["token", "gid"])
    listed = listed.withColumn("many", F.count(F.lit(1)).over(Window.partitionBy("token"))).filter("many > 1").drop("many")
    listed = materialize(listed, "shingle_lists")
    signed = materialize(signed.select("doc_id", "s1", "s2", "n"), "shingle_sets")
    remove_folders(docs.sparkSession, prefixes)

    inner = nodes.join(groups.filter("members > 1").select("gid"), "gid", "left_semi").select(
        F.col("gid").alias("token"), "node", "n", F.lit(0).alias("pos"))
    first = listed.join(groups.select("gid", "node"), "gid").select("token", "node", "n", "pos").unionByName(inner)

    size_class = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(4 / 3)))
    line = Window.partitionBy("token").orderBy("n", "node")
    head = Window.partitionBy("token", "class").orderBy("n", "node")
    member = F.struct("node", "n", "pos")
    near = {f"before{d}": F.lag(member, d).over(line) for d in NEIGHBOURS}
    neighbours = first.withColumn("class", size_class).withColumns(near | {"head": F.first(member).over(head)}).select(
        "node", "n", "pos", F.explode(F.array_compact(F.array("head", *near))).alias("o"))
    pairs = neighbours.filter("o is not null and o.node != node").select(
        F.col("o.node").alias("x"), F.col("o.n").alias("nx"), F.col("o.pos").alias("px"),
        F.col("node").alias("y"), F.col("n").alias("ny"), F.col("pos").alias("py")).filter(compatible("nx", "ny", "px", "py"))
    pairs = materialize(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "near_pairs")
    texts = packed_texts(rows.select("t1", "t2", "text"))
    links = materialize(verify(pairs, nodes, texts), "near_links")
    found = settled(docs.sparkSession, "near_components", lambda: components(links))

    # Every other pair that meets in a list and is not in one component yet.
    members = listed.join(nodes.select("gid", "node"), "gid").select("token", "node", "n", "pos").unionByName(inner)
    members = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    whole = Window.partitionBy("token")
    mixed = members.withColumn("low", F.min("component").over(whole)).withColumn("high", F.max("component").over(whole))
    mixed = materialize(mixed.filter("low != high").drop("low", "high"), "mixed_lists")
    x = mixed.select("token", *[F.col(c).alias(f"x_{c}") for c in ("node", "n", "pos", "component")])
    y = mixed.select("token", *[F.col(c).alias(f"y_{c}") for c in ("node", "n", "pos", "component")])
    ahead = (F.col("x_n") < F.col("y_n")) | ((F.col("x_n") == F.col("y_n")) & (F.col("x_node") < F.col("y_node")))
    more = x.join(y, "token").filter((F.col("x_component") != F.col("y_component")) & ahead & compatible("x_n", "y_n", "x_pos", "y_pos"))
    more = more.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()
    more = materialize(more.join(pairs, ["a", "b"], "left_anti"), "mixed_pairs")
    late = materialize(verify(more, nodes, texts), "mixed_links")
    edges = found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(late)
    found = settled(docs.sparkSession, "near_components", lambda: components(edges))

    named_nodes = nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named_nodes.groupBy("component").agg(F.min("first").alias("component_id"))
    labels = named_nodes.join(least, "component").select("s1", "s2", "n", "component_id")
    return signed.select("doc_id", "s1", "s2", "n").join(
        labels.withColumnRenamed("n", "m"), ["s1", "s2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, with its own columns: the one with the smallest id.

    Rows that repeat that id are told apart by their text, then by their place
    in the input, and one of them stays.  Documents without words all stay.
    """
    own = docs.columns
    packed = docs.select(F.struct(*[named(docs, c) for c in own]).alias("_row"), named(docs, doc_id).cast("long").alias("doc_id"),
                         F.monotonically_increasing_id().alias("row"))
    packed = materialize(packed, "near_rows")  # its row numbers hold from here on

    def chosen() -> DataFrame:
        found = near_duplicates(packed.select(F.col("row").alias("doc_id"), F.col("_row").getField(text).alias("text")))
        found = found.withColumnRenamed("doc_id", "row").join(packed.select("row", "doc_id"), "row")
        turn = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
        best = found.filter("n_shingles > 0").groupBy("component_id").agg(F.min(turn).alias("best")).select("best.row")
        return best.unionByName(found.filter("n_shingles = 0").select("row"))

    stay = settled(docs.sparkSession, "near_stay", chosen)
    return packed.join(stay, "row", "left_semi").select("_row.*")
