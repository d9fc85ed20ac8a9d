import json
import random

import pytest
from pyspark.sql import functions as F

from siftrank.scratch import memory_bytes, shared_dir
from siftrank.schemas import WANDS_LABEL_TSV
from siftrank.sources import exchange, indexes, tables, versions


def test_tsv(spark, tmp_path):
    path = tmp_path / "label.csv"
    path.write_text("id\tquery_id\tproduct_id\tlabel\n1\t7\t5\tExact\n2\t7\t6\tsaid \"\"hi\"\"\n3\t8\n")
    rows = tables.read_tsv(spark, str(path), WANDS_LABEL_TSV, keep_corrupt=True).collect()
    assert [(r.id, r.label) for r in rows] == [("1", "Exact"), ("2", 'said ""hi""'), ("3", None)]
    assert [r[tables.CORRUPT] for r in rows] == [None, None, "3\t8"]


def test_tsv_round_trip(spark, tmp_path):
    frame = spark.createDataFrame([("a\tb", 'q"x"', "é"), (None, " s ", "1")], "x string, y string, z string")
    tables.write_tsv(frame, str(tmp_path / "t"))
    back = tables.read_tsv(spark, str(tmp_path / "t"), frame.schema)
    assert {r.y for r in back.collect()} == {'q"x"', " s "}
    assert "a\tb" in {r.x for r in back.collect()}


def test_quoted_line_ends(spark, tmp_path):
    frame = spark.createDataFrame([("1", "red\nsofa, \"big\""), ("2", " lamp ")], "query_id string, query string")
    tables.write_csv(frame, str(tmp_path / "q.csv"))
    with pytest.raises(ValueError, match="multi_line"):
        tables.read_query_table(spark, str(tmp_path / "q.csv"))
    back = tables.read_query_table(spark, str(tmp_path / "q.csv"), multi_line=True)
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in frame.collect()}


def test_query_table_by_suffix(spark, tmp_path):
    frame = spark.createDataFrame([("1", "red, sofa"), ("2", "lamp")], "query_id string, query string")
    frame.write.parquet(str(tmp_path / "q.parquet"))
    tables.write_csv(frame, str(tmp_path / "q.csv"))
    for name in ("q.parquet", "q.csv"):
        assert {tuple(r) for r in tables.read_query_table(spark, str(tmp_path / name)).collect()} == {
            ("1", "red, sofa"), ("2", "lamp")}


def test_nested_qrels(spark, tmp_path):
    path = tmp_path / "qrels.json"
    path.write_text(json.dumps({"q1": {"a": 3, "b": 1.0}, "q2": {}}, indent=1))
    rows = {tuple(r) for r in exchange.read_qrels_json(spark, str(path)).collect()}
    assert rows == {("q1", "a", 3.0), ("q1", "b", 1.0), ("q2", None, None)}


def test_large_query_takes_several_lines(spark, tmp_path):
    qrels = spark.range(100).select(F.lit("hot").alias("query_id"), F.col("id").cast("string").alias("product_id"),
                                    F.lit(1.0).alias("gain"))
    exchange.write_qrels_json(qrels, str(tmp_path / "q"), rows_per_line=10)
    lines = spark.read.text(str(tmp_path / "q")).count()
    assert 5 <= lines <= 10
    back = exchange.read_qrels_json(spark, str(tmp_path / "q"))
    assert back.count() == 100 and back.exceptAll(qrels).count() == 0


def test_ranked_lists(spark, tmp_path):
    path = tmp_path / "run.json"
    path.write_text(json.dumps({"q1": ["b", "a"], "q2": []}))
    got = exchange.read_ranked_json(spark, str(path))
    assert {tuple(r) for r in got.collect()} == {("q1", "b", 1), ("q1", "a", 2)}
    run = spark.range(25).select(F.lit("q").alias("query_id"), F.col("id").cast("string").alias("product_id"),
                                 (F.col("id") + 1).alias("rank"))
    exchange.write_run_json(run, str(tmp_path / "r"), rows_per_line=10)
    assert spark.read.text(str(tmp_path / "r")).count() == 3
    assert exchange.read_run_json(spark, str(tmp_path / "r")).exceptAll(run).count() == 0


def test_nested_objects_of_any_size_are_split(spark, tmp_path):
    run = {f"q{i}": [f"p{i}-{j}" for j in range(i % 5)] for i in range(300)}
    path = tmp_path / "run.json"
    path.write_text(json.dumps(run, indent=2))
    rows = exchange.read_ranked_json(spark, str(path)).collect()
    assert sorted(tuple(r) for r in rows) == sorted((q, p, i + 1) for q, own in run.items() for i, p in enumerate(own))
    frame = spark.createDataFrame(rows)
    exchange.write_ranked_json(frame, str(tmp_path / "again"))
    assert exchange.read_ranked_json(spark, str(tmp_path / "again")).exceptAll(frame).count() == 0
    odd = tmp_path / "odd.json"
    odd.write_text(json.dumps({"q1": ["a"]})[:-1] + ', "q2" "b": [1]}')
    with pytest.raises(Exception, match="not a record|cannot be read"):
        exchange.read_ranked_json(spark, str(odd)).collect()
    odd.write_text(json.dumps({'q"2, {': ['b"', "c\n]"], "é": ["x"], "q]1": ["["]}))
    assert {tuple(r) for r in exchange.read_ranked_json(spark, str(odd)).collect()} == {
        ('q"2, {', 'b"', 1), ('q"2, {', "c\n]", 2), ("é", "x", 1), ("q]1", "[", 1)}


def test_product_store(spark, tmp_path):
    from siftrank.schemas import PRODUCT

    rows = [("p1", "ESCI", "full", "short", "b", ["red", "blue"], None, None, 4.5, 3, {"a": "1", "b": None}, {}),
            ("p2", "WANDS", "x\n}y", "", None, [], "class", "a / b", None, None, {}, {"k": "{v}"})]
    frame = spark.createDataFrame(rows, PRODUCT)
    exchange.write_product_store(frame, str(tmp_path / "store"))
    back = exchange.read_product_store(spark, str(tmp_path / "store"))
    want = {r.product_id: r.asDict(recursive=True) for r in frame.collect()}
    for r in back.collect():
        got = r.asDict(recursive=True)
        assert {k: v for k, v in got.items() if k != "metadata"} == {
            k: v for k, v in want[r.product_id].items() if k != "metadata"}
    whole = tmp_path / "store.json"
    whole.write_text(json.dumps({"p1": {"source": "ESCI", "color": ["red"], "metadata": {"a": "b"}}, "p2": {"source": "W"}}, indent=1))
    found = exchange.read_product_store(spark, str(whole)).collect()
    assert {(r.product_id, r.source) for r in found} == {("p1", "ESCI"), ("p2", "W")}
    exchange.write_product_store(frame.coalesce(1), str(tmp_path / "one"), one_object=True)
    (file,) = (tmp_path / "one").glob("part-*")
    assert set(json.loads(file.read_text())) == {"p1", "p2"}
    assert {r.product_id for r in exchange.read_product_store(spark, str(tmp_path / "one")).collect()} == {"p1", "p2"}


@pytest.fixture(params=["128m", "150", "37"])
def split_size(request, spark):
    """Files in splits of so many bytes, down to several splits in a record."""
    names = {"spark.sql.files.maxPartitionBytes": request.param, "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_quoted_line_ends_in_many_splits(spark, tmp_path, split_size):
    own = random.Random(1)
    texts = ["plain", 'a "quoted" word', "line\nend", 'two\n\n"ends"\n', "tab\tin, and comma", '5" shelf', " s ", 'é\n"', None, '"', '""', '",\n"']
    frame = spark.createDataFrame([(str(i), own.choice(texts)) for i in range(200)], "query_id string, query string")
    want = {tuple(r) for r in frame.collect()}
    for write, read, end in ((tables.write_csv, tables.read_query_table, ".csv"), (tables.write_tsv, tables.read_tsv, ".tsv")):
        path = str(tmp_path / f"q{end}")
        write(frame.coalesce(1), path)
        back = read(spark, path, frame.schema, multi_line=True).collect()
        assert len(back) == 200 and {tuple(r) for r in back} == want
    assert spark.read.text(path).rdd.getNumPartitions() > (1 if split_size != "128m" else 0)


def test_files_with_quotes_that_open_no_string(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('query_id,query\r\n1,5" shelf\r\n2,"two\r\nlines"\r\n\r\n3,a""b\r\n4,"c" d')
    found = tables.read_query_table(spark, str(path), multi_line=True).collect()
    assert [(r.query_id, r.query.replace("\r", "")) for r in found][:3] == [("1", '5" shelf'), ("2", "two\nlines"), ("3", 'a""b')]
    assert len(found) == 4


def test_one_object_in_many_splits(spark, tmp_path, split_size):
    own = random.Random(2)
    texts = ["a } b", "{", 'x"}', "\n}", "[", "\\", "é"]
    store = {f"p}}{i}": {"source": "A", "full_text": own.choice(texts), "encode_text": "e", "color": ["r"], "metadata": {"k": own.choice(texts)}}
             for i in range(60)}
    run = {f"q]{i}": [f"p[{j}" for j in range(i % 4)] for i in range(50)}
    judged = {f"q{i}": {f"}}{j}": 1.0 + j for j in range(i % 3 + 1)} for i in range(40)}
    for indent in (None, 1):
        for name, data in (("store", store), ("run", run), ("judged", judged)):
            (tmp_path / f"{name}{indent}.json").write_text(json.dumps(data, indent=indent))
        found = exchange.read_product_store(spark, str(tmp_path / f"store{indent}.json")).collect()
        assert {r.product_id: (r.full_text, r.metadata["k"]) for r in found} == {k: (v["full_text"], v["metadata"]["k"]) for k, v in store.items()}
        ranked = exchange.read_ranked_json(spark, str(tmp_path / f"run{indent}.json")).collect()
        assert sorted(map(tuple, ranked)) == sorted((q, p, i + 1) for q, own_ in run.items() for i, p in enumerate(own_))
        gains = exchange.read_qrels_json(spark, str(tmp_path / f"judged{indent}.json")).collect()
        assert sorted(map(tuple, gains)) == sorted((q, p, g) for q, own_ in judged.items() for p, g in own_.items())


def documents(spark, text="red sofa"):
    return spark.createDataFrame([("a", "A", text), ("b", "B", "blue sofa sofa")],
                                 "product_id string, source string, title string")


def test_index_lifecycle(spark, tmp_path):
    path = str(tmp_path / "index")
    indexes.write_lexical(documents(spark), ["title"], path, term_buckets=4)
    indexes.write_lexical(documents(spark, "green"), ["title"], path, term_buckets=4)  # kept
    index = indexes.read_lexical(spark, path)
    assert {(r.term, r.df) for r in index.term_df().collect()} == {("red", 1), ("sofa", 2), ("blue", 1)}
    stats = index.field_stats().first()
    assert (stats.n_docs, stats.avgdl) == (2, 2.5)
    assert {(r.product_id, r.dl) for r in index.lengths().collect()} == {("a", 2), ("b", 3)}
    indexes.write_lexical(documents(spark, "green"), ["title"], path, recreate=True, term_buckets=4)
    assert "green" in {r.term for r in indexes.read_lexical(spark, path).term_df().collect()}


def test_vector_index(spark, tmp_path):
    path = str(tmp_path / "vectors")
    rows = indexes.vector_rows(documents(spark), lambda c: F.array(F.length(c) * 1.0, F.lit(1.0)), 2, text="title")
    indexes.write_vectors(rows, path)
    assert {(r.product_id, tuple(r.embedding)) for r in indexes.read_vectors(spark, path).collect()} == {
        ("a", (8.0, 1.0)), ("b", (14.0, 1.0))}
    wrong = indexes.vector_rows(documents(spark), lambda c: F.array(F.lit(1.0)), 2, text="title")
    with pytest.raises(Exception, match="expected 2 numbers, got 1"):
        wrong.collect()


SCHEMA = "product_id string, title string, source string"


def products(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def stored(index):
    return {(r.product_id, r.title, r.source) for r in index.documents().collect()}


def test_upsert(spark, tmp_path):
    index = indexes.create_index(products(spark, ("a", "1", "A"), ("b", "1", "A"), ("c", "1", "C")), str(tmp_path / "docs"))
    after = index.upsert([products(spark, ("b", "2", "A"), ("n", "2", "A")), products(spark, ("b", "3", "A"))])
    assert stored(after) == {("a", "1", "A"), ("b", "3", "A"), ("n", "2", "A"), ("c", "1", "C")}
    assert stored(index) == {("a", "1", "A"), ("b", "1", "A"), ("c", "1", "C")}  # a reader keeps its version
    assert stored(indexes.open_index(spark, str(tmp_path / "docs"))) == stored(after)


def test_upsert_of_null_and_moved_sources(spark, tmp_path):
    before = products(spark, ("a", "1", None), ("b", "1", None), ("c", "1", "C"), ("d", "1", "D"), ("e", "1", "E"))
    index = indexes.create_index(before, str(tmp_path / "docs"))
    index = index.upsert([products(spark, ("a", "2", None), ("c", "2", "D"), ("n", "2", "N"))], deleted=products(spark, ("e", None, None)))
    assert stored(index) == {("a", "2", None), ("b", "1", None), ("c", "2", "D"), ("d", "1", "D"), ("n", "2", "N")}


def statistics(index):
    words = index.lexical()
    return ({(r.field, r.term, r.df) for r in words.term_df().collect()}, {tuple(r) for r in words.field_stats().collect()},
            {(r.field, r.term, r.product_id, r.source, r.tf, r.dl) for r in words.postings.collect()},
            {(r.term, r.limit) for r in words.limits(words.postings.select("term"), ["title"], 1.2, 0.75).collect()})


def test_upserts_in_any_number_equal_a_fresh_index(spark, tmp_path):
    own, words = random.Random(7), ["red", "blue", "sofa", "chair", "lamp"]
    live = {f"p{i}": (" ".join(own.choices(words, k=own.randrange(6))), "A") for i in range(40)}
    index = indexes.create_index(products(spark, *[(p, *v) for p, v in live.items()]), str(tmp_path / "many"), ["title"], term_buckets=4, product_buckets=4)
    merged = 0
    for step in range(6):
        batch = {f"p{own.randrange(50)}": (" ".join(own.choices(words, k=own.randrange(6))), own.choice(["A", "B"])) for _ in range(3)}
        gone = own.sample(sorted(live), 2) if step % 2 else []
        gone = [p for p in gone if p not in batch]
        live = {k: v for k, v in live.items() if k not in gone} | batch
        index = index.upsert([products(spark, *[(p, *v) for p, v in batch.items()])],
                             deleted=products(spark, *[(p, None, None) for p in gone]) if gone else None)
        merged += any("merged" in s for s in index.segments)
    assert merged and len(index.segments) < 7
    assert stored(index) == {(p, *v) for p, v in live.items()}
    fresh = indexes.create_index(products(spark, *[(p, *v) for p, v in live.items()]), str(tmp_path / "fresh"), ["title"], term_buckets=4)
    assert statistics(index)[:3] == statistics(fresh)[:3]
    # Bounds may be kept from rows that are gone, so they are never too low.
    loose, exact = dict(statistics(index)[3]), dict(statistics(fresh)[3])
    assert all(loose[t] >= exact[t] - 1e-12 for t in exact)


def test_an_upsert_writes_no_more_than_its_rows(spark, tmp_path):
    rows = spark.range(2000).select(F.concat(F.lit("p"), "id").alias("product_id"), F.concat(F.lit("word number "), F.col("id") % 97).alias("title"),
                                    F.lit("A").alias("source"))
    index = indexes.create_index(rows, str(tmp_path / "share"), ["title"], text="title", encode=lambda c: F.array(F.length(c) * 1.0), dimension=1)
    whole = index.segments[0]["tables"]
    batch = rows.filter("product_id < 'p101'").withColumn("title", F.concat("title", F.lit(" again")))
    n = batch.count()
    after = index.upsert([batch.unionByName(rows.filter("product_id > 'p99'"))], encode=lambda c: F.array(F.length(c) * 1.0))
    new = after.segments[-1]
    assert new["tables"]["documents"] == new["tables"]["gone"] == new["tables"]["vectors"] == new["encoded"] == n
    assert new["tables"]["postings"] == 4 * n and whole["postings"] == 6000
    assert after.vectors().count() == 2000


def test_only_changed_texts_are_encoded(spark, tmp_path):
    encode = lambda c: F.array(F.length(c) * 1.0, F.lit(1.0))
    index = indexes.create_index(products(spark, ("a", "one", "A"), ("b", "two", "A"), ("c", None, "A")), str(tmp_path / "v"), text="title",
                                 encode=lambda c: F.array(F.coalesce(F.length(c), F.lit(0)) * 1.0, F.lit(1.0)), dimension=2)
    after = index.upsert([products(spark, ("a", "one", "B"), ("b", "three", "A"), ("d", "four", "D"))], encode=encode)
    assert after.segments[-1]["encoded"] == 2
    found = {r.product_id: (r.source, r.embedding[0]) for r in after.vectors().collect()}
    assert found == {"a": ("B", 3.0), "b": ("A", 5.0), "c": ("A", 0.0), "d": ("D", 4.0)}
    with pytest.raises(ValueError, match="needs encode"):
        after.upsert([products(spark, ("a", "x", "B"))])


def test_rejected_vectors_are_counted(spark, tmp_path):
    rows = products(spark, ("a", "one", "A"), ("b", "three", "A"), ("c", "two", "A"))
    encode = lambda c: F.when(F.length(c) == 3, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.array(F.lit(1.0)))
    index = indexes.create_index(rows, str(tmp_path / "skip"), text="title", encode=encode, dimension=2, skip_rejected=True)
    assert {r.what: r.n for r in index.report().collect()} == {"documents": 3, "vectors": 2, "encoded": 3, "rejected": 1}
    assert {r.product_id for r in index.vectors().collect()} == {"a", "c"}
    with pytest.raises(Exception, match="expected 2 numbers, got 1"):
        indexes.create_index(rows, str(tmp_path / "stop"), text="title", encode=encode, dimension=2)
    with pytest.raises(ValueError, match="no complete index"):
        indexes.open_index(spark, str(tmp_path / "stop"))


def test_versions_are_numbered_and_pruned(spark, tmp_path):
    path = str(tmp_path / "versions")
    index = indexes.create_index(products(spark, ("a", "1", "A")), path)
    for title in ("2", "3"):
        index = index.upsert([products(spark, ("a", title, "A"))])
    assert [v for v in (1, 2, 3) if versions.published(spark, path, v)] == [1, 2, 3]
    assert stored(indexes.open_index(spark, path, version=2)) == {("a", "2", "A")}
    with pytest.raises(RuntimeError, match="is taken"):
        versions.publish(spark, path, {"segments": []}, after=2)  # a writer that started from an old version
    again = indexes.create_index(products(spark, ("z", "9", "Z")), path, recreate=True)
    gone = versions.prune(spark, path, keep=1)
    assert len(gone) == 3 and not any((tmp_path / "versions" / name).exists() for name in gone)
    assert stored(again) == {("z", "9", "Z")} and versions.published(spark, path, 1) is None
    assert stored(indexes.create_index(products(spark, ("q", "0", "Q")), path)) == {("z", "9", "Z")}  # a published one stays


def test_index_of_nothing(spark, tmp_path):
    index = indexes.create_index(products(spark, ("a", "1", "A")).limit(0), str(tmp_path / "none"), ["title"], text="title",
                                 encode=lambda c: F.array(F.lit(1.0)), dimension=1)
    assert stored(index) == set() and index.vectors().count() == 0 and index.lexical().postings.count() == 0
    index = index.upsert([products(spark, ("a", "1", "A"))], encode=lambda c: F.array(F.lit(1.0)))
    assert stored(index) == {("a", "1", "A")} and index.lexical().field_stats().first().n_docs == 1


def test_half_built_index_is_not_read(spark, tmp_path):
    path = str(tmp_path / "index")
    with pytest.raises(ValueError, match="no complete index"):
        indexes.read_lexical(spark, path)
    (tmp_path / "index" / "segment-x" / "postings").mkdir(parents=True)
    indexes.write_lexical(documents(spark), ["title"], path)
    assert indexes.read_lexical(spark, path).postings.count() == 4


def test_memory_size_counts_values(spark):
    frame = spark.range(1000).select(F.lit("x" * 100).alias("s"), F.array(F.lit(1.0), F.lit(2.0)).alias("v"), "id")
    assert memory_bytes(frame) == 1000 * (100 + 16 + 2 * 8 + 16 + 8)
    assert memory_bytes(frame.limit(0)) == 0


def test_shared_dir_is_that_of_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert named is None or shared_dir(spark) == named.rstrip("/")


def test_counts_on_the_way(spark, tmp_path):
    rows = spark.range(20).withColumn("odd", F.col("id") % 2 == 1)
    found = tables.write_counted(rows, str(tmp_path / "even"), {"all": F.lit(True), "odd": F.col("odd")}, keep=~F.col("odd"))
    assert found == {"all": 20, "odd": 10} and spark.read.parquet(str(tmp_path / "even")).count() == 10
    assert tables.write_counted(rows.limit(0), str(tmp_path / "none"), {"all": F.lit(True)}) == {"all": 0}
