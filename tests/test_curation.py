import pytest
from pyspark.sql import functions as F

from siftrank.fixed_values import ESCI_GAINS
from siftrank.operators import curation, merging, sampling, training
from siftrank.operators.ranking import full_rank, top_n


def qrels_of(spark, rows, **options):
    judged = spark.createDataFrame(rows, "query_id string, product_id string, label string")
    options = {"cap": 40, **options}
    return {(r.query_id, r.product_id): r.gain
            for r in curation.build_qrels(judged, label="label", gains=ESCI_GAINS, prefix="amz_", **options).collect()}


def test_qrels(spark):
    rows = [("1", "a", " exact "), ("1", "b", "E"), ("1", "c", "what"), ("1", "d", "S"), ("1", "d", "E"),
            ("1", "e", "I"), (None, "a", "E"), ("2", None, "E")]
    assert qrels_of(spark, rows) == {("amz_1", "amz_a"): 3.0, ("amz_1", "amz_b"): 3.0, ("amz_1", "amz_d"): 3.0}
    assert qrels_of(spark, rows, keep_irrelevant=True)["amz_1", "amz_e"] == 0.0


def test_qrels_cap(spark):
    rows = [("1", f"p{i:02d}", "S") for i in range(41)] + [("1", "z", "E")]
    kept = qrels_of(spark, rows)
    assert len(kept) == 40 and ("amz_1", "amz_z") in kept and ("amz_1", "amz_p38") in kept
    assert len(qrels_of(spark, rows, cap=None)) == 42


def datasets(spark):
    examples = spark.createDataFrame(
        [("1", "red sofa", "a", "us", "E", 1, 1, "train", 1), ("1", "late text", "b", "us", "S", 1, 1, "train", 2),
         ("2", "lamp", "a", "us", "I", 1, 1, "test", 3), ("2", "lamp", "c", "us", "C", 1, 1, "test", 4),
         ("3", "x", "a", "es", "E", 1, 1, "test", 5), ("4", "x", "a", "us", "E", 0, 1, "test", 6)],
        "query_id string, query string, product_id string, product_locale string, esci_label string, "
        "small_version int, large_version int, split string, row_no int")
    products = spark.createDataFrame(
        [("a", "us", "Sofa", "nan", "soft|warm", " Acme ", "Red/Blue"), ("a", "es", "Divan", None, None, None, None),
         ("b", "us", "Chair", "wood", None, None, None)],
        "product_id string, product_locale string, product_title string, product_description string, "
        "product_bullet_point string, product_brand string, product_color string")
    esci = curation.EsciDataset(examples, products, ("row_no",))
    queries = spark.createDataFrame([("7", "rug", "rugs")], "query_id string, query string, query_class string")
    labels = spark.createDataFrame([("1", "7", "5", "Exact", "test"), ("2", "7", "9", "Exact", "test")],
                                   "id string, query_id string, product_id string, label string, split string")
    wands_products = spark.createDataFrame(
        [("5", "Rug", "Rugs", "Home / Rugs", "woven", "Colour:Teal|Size:2 m", "1", "4.7", "12.0")],
        curation_schema())
    return esci, curation.WandsDataset(queries, labels, wands_products)


def curation_schema():
    from siftrank.schemas import WANDS_PRODUCT_TSV
    return WANDS_PRODUCT_TSV


def test_products(spark):
    esci, wands = datasets(spark)
    merged = {r.product_id: r for r in merging.merge([esci, wands]).products.collect()}
    assert set(merged) == {"amz_a", "amz_b", "amz_c", "wands_5"}
    sofa, rug = merged["amz_a"], merged["wands_5"]
    assert (sofa.full_text, sofa.encode_text, sofa.brand) == ("Sofa Acme soft warm", "Sofa Acme red blue", "acme")
    assert (rug.full_text, rug.encode_text) == ("Rug Rugs Home / Rugs Teal 2 m woven", "Rug Rugs teal")
    assert (rug.category_path, rug.average_rating, rug.review_count, rug.color) == ("Home / Rugs", 4.7, 12, ["teal"])
    assert merged["amz_c"].full_text == ""


def test_queries_and_qrels(spark):
    esci, wands = datasets(spark)
    merged = merging.merge([esci, wands])
    assert {(r.query_id, r.query) for r in merged.train_queries.collect()} == {("amz_1", "red sofa")}
    assert {r.query_id for r in merged.test_queries.collect()} == {"amz_2", "wands_7"}
    assert {(r.query_id, r.product_id, r.gain) for r in merged.test_qrels.collect()} == {
        ("amz_2", "amz_c", 1.0), ("wands_7", "wands_5", 2.0)}
    with pytest.raises(ValueError):
        merging.merge([])


def test_index_documents(spark):
    merged = merging.merge(list(datasets(spark)))
    rows = {r.product_id: r for r in curation.index_documents(merged.products).collect()}
    assert (rows["amz_a"].title, rows["amz_a"].bullets, rows["amz_a"].brand_text) == ("Sofa", "soft warm", "Acme")
    assert (rows["wands_5"].title, rows["wands_5"].bullets, rows["wands_5"].description) == ("Rug", None, "woven")


def test_keep_first_and_conflicts(spark):
    one = spark.createDataFrame([("a", 1), ("b", 1)], "product_id string, v int")
    two = spark.createDataFrame([("b", 2), ("c", 2)], "product_id string, v int")
    kept = {r.product_id: r.v for r in merging.keep_first([one, two], ["product_id"]).collect()}
    assert kept == {"a": 1, "b": 1, "c": 2}
    assert [tuple(r) for r in merging.conflicts([one, two], "product_id").collect()] == [("b", 2, 1)]


def test_replace_queries(spark):
    schema = "query_id string, product_id string, gain double"
    base = spark.createDataFrame([("1", "a", 1.0), ("2", "a", 1.0)], schema)
    update = spark.createDataFrame([("2", "z", 2.0)], schema)
    got = {tuple(r) for r in merging.replace_queries(base, update).collect()}
    assert got == {("1", "a", 1.0), ("2", "z", 2.0)}


@pytest.mark.parametrize("partitions", [1, 7])
def test_split_has_no_leak(spark, partitions):
    rows = spark.range(1000).select((F.col("id") % 103).cast("string").alias("query_id"), "id").repartition(partitions)
    split = sampling.split_queries(rows)
    sides = split.groupBy("query_id").agg(F.collect_set("split").alias("s")).collect()
    assert split.count() == 1000 and all(len(r.s) == 1 for r in sides)
    train = sorted(r.query_id for r in sides if r.s == ["train"])
    assert len(train) == int(103 * 0.7)
    assert train == sorted(r.query_id for r in sampling.split_queries(rows.coalesce(1)).filter("split = 'train'")
                           .select("query_id").distinct().collect())


def test_overlap_is_an_error(spark):
    one, two = (spark.range(a, b).withColumnRenamed("id", "query_id") for a, b in ((0, 5), (5, 9)))
    sampling.checked_disjoint(one, two)
    with pytest.raises(ValueError):
        sampling.checked_disjoint(one, two.unionAll(one))


def test_stratified_sample(spark):
    rows = spark.range(1000).select(F.col("id").alias("query_id"), F.when(F.col("id") < 990, "big").otherwise("tiny").alias("source"))
    counts = {r.source: r["count"] for r in sampling.stratified_sample(rows, 40).groupBy("source").count().collect()}
    assert counts == {"big": 40, "tiny": 1}
    assert sampling.stratified_sample(rows.drop("source"), 40).count() == 40


def test_dev_sample(spark):
    sample = sampling.dev_sample(list(datasets(spark)), 1, 1, 1)
    ids = {r.product_id for r in sample.products.collect()}
    assert {"amz_a", "amz_b", "amz_c", "wands_5"} >= ids and {"amz_a", "amz_b"} <= ids
    assert sample.train_queries.count() == 1 and sample.test_queries.count() == 2


def test_training_pairs(spark):
    esci, _ = datasets(spark)
    schema = "query_id string, product_id string, gain double"
    qrels = spark.createDataFrame(
        [("amz_1", "amz_b", 2.0), ("amz_1", "amz_a", 3.0), ("amz_9", "amz_a", 1.0), ("amz_2", "gone", 1.0),
         ("amz_5", "amz_c", 1.0), ("amz_6", "amz_a", None)], schema)
    queries = spark.createDataFrame([("amz_1", "sofa"), ("amz_2", "lamp"), ("amz_5", "x"), ("amz_6", "y")],
                                    "query_id string, query string")
    rows = training.training_candidates(qrels, queries, esci.products())
    assert {r.outcome: r.queries for r in training.training_report(rows).collect()} == {
        "pair": 1, "no_query": 1, "missing_product": 1, "empty_text": 1, "no_positive": 1}
    assert [tuple(r) for r in training.training_pairs(rows, 5).collect()] == [("amz_1", "sofa", "Sofa Acme")]


def skewed(spark):
    """One key holds a third of the rows."""
    return spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"),
        (F.col("id") * 7919 % 9001).alias("v"), "id")


def brute_ranks(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r.k, []).append((r.v, r.id))
    return {(k, i): n for k, g in groups.items() for n, (_, i) in enumerate(sorted(g), 1)}


def test_full_rank_of_a_hot_group(spark):
    frame = skewed(spark)
    ranked = full_rank(frame, ["k"], [F.asc("v"), F.asc("id")])
    assert {(r.k, r.id): r["rank"] for r in ranked.collect()} == brute_ranks(frame.collect())
    everything = full_rank(frame, [], [F.asc("v"), F.asc("id")])
    assert sorted(r["rank"] for r in everything.collect()) == list(range(1, 9001))


@pytest.mark.parametrize("n", [3, 1500])
def test_top_n_of_a_hot_group(spark, n):
    frame = skewed(spark)
    want = {key: rank for key, rank in brute_ranks(frame.collect()).items() if rank <= n}
    got = top_n(frame, ["k"], [F.asc("v"), F.asc("id")], n)
    assert {(r.k, r.id): r["rank"] for r in got.collect()} == want


def test_cut_of_the_hash_selects_the_first_in_mixed_order(spark, monkeypatch):
    ids = spark.range(700).select(F.concat(F.lit("q"), "id").alias("query_id"))
    order = [r.query_id for r in ids.orderBy(*sampling.shuffled("query_id", 7)).collect()]
    for digits in (1, 2, 4):
        monkeypatch.setattr(sampling, "DIGITS", digits)
        for n in (0, 1, 2, 17, 350, 699, 700, 900):
            found = {r.query_id for r in sampling.first_mixed(ids, n, "query_id", 7).collect()}
            assert found == set(order[:n]), (digits, n)
    assert sampling.first_mixed(ids.limit(0), 5).count() == 0


def test_repeated_ids_stay_on_one_side(spark):
    ids = spark.range(90).select((F.col("id") % 9).cast("string").alias("query_id"))
    assert sampling.first_mixed(ids, 15).count() in (10, 20)


def test_selection_sorts_nothing(spark, capsys):
    ids = spark.range(100).select(F.col("id").cast("string").alias("query_id"))
    rows = ids.unionByName(ids)
    split = sampling.split_queries(rows)
    assert {r.split: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 140, "test": 60}
    for frame in (split, sampling.sample_queries(ids, 7, 3)):
        frame.explain()
        text = capsys.readouterr().out
        assert "rangepartitioning" not in text and "Limit" not in text and "TakeOrdered" not in text and "Sort" not in text
