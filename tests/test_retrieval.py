import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftrank.operators import dense, evaluation, fusion, lexical, rerank
from siftrank.plans import benchmark
from siftrank.plans.strategies import Search, distinct_texts, for_all
from siftrank.functions import models
from siftrank.sources import indexes

WORDS = [f"w{i}" for i in range(30)]
BOOSTS = {"title": 5.0, "body": 0.3}


def collection(n, seed=1):
    """Random titles and bodies; one word is in every third product, many products are copies."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(1, 6))] + (["hot"] if i % 3 == 0 else [])
        title = "hot copy" if i % 4 == 0 else " ".join(words)
        rows.append((f"p{i:04d}", "A" if i % 2 else "B", title, None if i % 7 == 0 else " ".join(words * 2)))
    return rows


def brute_bm25(rows, query, k, source=None):
    fields = {"title": 2, "body": 3}
    docs = {f: {r[0]: (r[at] or "").lower().split() for r in rows} for f, at in fields.items()}
    best = {}
    for field, words in docs.items():
        known = [w for w in words.values() if w]
        n, avg = len(known), sum(map(len, known)) / len(known)
        for r in rows:
            mine = words[r[0]]
            total = 0.0
            for term in query.split():
                tf = mine.count(term)
                if tf:
                    df = sum(term in w for w in known)
                    idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
                    total += idf * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * len(mine) / avg))
            if total:
                best[r[0]] = max(best.get(r[0], 0.0), BOOSTS[field] * total)
    wanted = {r[0] for r in rows if source in (None, r[1])}
    ranked = sorted(((p, round(s, 6)) for p, s in best.items() if p in wanted), key=lambda x: (-x[1], x[0]))
    return ranked[:k]


@pytest.fixture(scope="module")
def shop(spark):
    rows = collection(300)
    frame = spark.createDataFrame(rows, "product_id string, source string, title string, body string")
    return rows, lexical.build_index(frame, ["title", "body"])


QUERIES = [("q1", "hot w1 w2"), ("q2", "w3 w3 w9"), ("q3", "absent"), ("q4", "hot")]


def ranked(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.product_id, r.score))
    return out


@pytest.mark.parametrize("source", [None, "A"])
@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_bm25_against_brute_force(spark, shop, source, threshold):
    rows, index = shop
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        queries = spark.createDataFrame(QUERIES, "query_id string, query string")
        got = ranked(lexical.bm25(index, queries, 20, BOOSTS, filter_source=source, rows_per_part=7))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = {q: brute_bm25(rows, t, 20, source) for q, t in QUERIES}
    assert "q3" not in got
    for q in ("q1", "q2", "q4"):
        assert [p for p, _ in got[q]] == [p for p, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=2e-6)


def test_source_filter_per_query(spark, shop):
    rows, index = shop
    queries = spark.createDataFrame([("a", "hot", "A"), ("n", "hot", None)],
                                    "query_id string, query string, filter_source string")
    got = ranked(lexical.bm25(index, queries, 500, BOOSTS))
    assert {p for p, _ in got["a"]} == {r[0] for r in rows if r[1] == "A" and "hot" in r[2].split() + (r[3] or "").split()}
    assert len(got["n"]) > len(got["a"])


def test_smaller_k_is_a_prefix(spark, shop):
    queries = spark.createDataFrame(QUERIES, "query_id string, query string")
    small, large = (ranked(lexical.bm25(shop[1], queries, k, BOOSTS)) for k in (3, 4))
    assert all(large[q][:3] == small[q] for q in small)


@pytest.mark.parametrize("k, share", [(1, 0.25), (5, 0.0), (20, 0.25), (20, 0.9), (400, 0.25)])
def test_bounded_search_has_the_same_hits(spark, shop, k, share):
    rows, index = shop
    queries = spark.createDataFrame([*QUERIES, ("q5", "w5 w6 w7 w8 hot copy"), ("q6", "copy hot")], "query_id string, query string")
    got = ranked(lexical.bm25_bounded(index, queries, k, BOOSTS, share=share))
    assert got == ranked(lexical.bm25(index, queries, k, BOOSTS))
    assert [p for p, _ in got["q5"]] == [p for p, _ in brute_bm25(rows, "w5 w6 w7 w8 hot copy", k)]


def test_bounded_search_leaves_out_most_postings(spark):
    own = np.random.default_rng(2)
    docs = [(f"p{i:05d}", "A", " ".join(f"t{w}" for w in own.zipf(1.3, 60) if w < 5000)) for i in range(3000)]
    index = lexical.build_index(spark.createDataFrame(docs, "product_id string, source string, title string"), ["title"])
    asked = [(f"q{i}", " ".join([f"t{w}" for w in own.zipf(1.3, 5) if w < 5000] + ["t1", "t2", "t3", f"t{own.integers(50, 900)}"])) for i in range(12)]
    queries = spark.createDataFrame(asked, "query_id string, query string")
    boosts = {"title": 1.0}
    assert ranked(lexical.bm25_bounded(index, queries, 10, boosts)) == ranked(lexical.bm25(index, queries, 10, boosts))
    found = lexical.bounded_search(index, queries, 10, boosts)
    weights = lexical.term_weights(index, lexical.query_terms(queries), boosts)
    whole = lexical.match(index.postings_of(weights), weights, by_product=True).count()
    assert sum(part.count() for part in (found.rare, found.more, found.rest) if part is not None) <= whole / 2


def test_bounded_search_of_an_upserted_index(spark, tmp_path):
    rows = collection(120)
    schema = "product_id string, source string, title string, body string"
    index = indexes.create_index(spark.createDataFrame(rows, schema), str(tmp_path / "index"), ["title", "body"], term_buckets=4)
    changed = [(p, s, f"w1 {t}", b) for p, s, t, b in rows[:20]]
    index = index.upsert([spark.createDataFrame(changed, schema)]).lexical()
    queries = spark.createDataFrame(QUERIES, "query_id string, query string")
    got = ranked(lexical.bm25_bounded(index, queries, 5, BOOSTS))
    assert got == ranked(lexical.bm25(index, queries, 5, BOOSTS))
    assert [p for p, _ in got["q1"]] == [p for p, _ in brute_bm25(changed + rows[20:], "hot w1 w2", 5)]


def vectors(spark, n, copies, seed=3):
    """Vectors of which ``copies`` are the same."""
    rng = np.random.default_rng(seed)
    matrix = rng.normal(size=(n, 8))
    matrix[:copies] = matrix[0]
    matrix[n - 1] = 0
    rows = [(f"p{i:04d}", "A" if i % 3 else "B", [float(x) for x in v]) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, "product_id string, source string, embedding array<double>"), rows


def brute_knn(rows, query, k, sources=("A", "B")):
    q = np.array(query) / np.linalg.norm(query)
    scored = []
    for p, s, v in rows:
        if np.linalg.norm(v) and s in sources:
            scored.append((p, round((1 + float(q @ np.array(v)) / np.linalg.norm(v)) / 2, 6)))
    return sorted(scored, key=lambda x: (-x[1], x[0]))[:k]


@pytest.mark.parametrize("options, kept", [({}, 32 << 20), ({"chunk_bytes": 500}, 32 << 20), ({"chunk_bytes": 500}, 500)])
def test_knn_against_brute_force(spark, options, kept, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK_BYTES", kept)
    monkeypatch.setattr(dense, "SCORE_CELLS", 500)
    frame, rows = vectors(spark, 400, 150)
    queries = frame.select(F.col("product_id").alias("query_id"), "embedding")
    got = ranked(dense.knn(frame, queries, 7, **options))
    assert len(got) == 399  # the zero vector has no neighbours
    for p, _, v in rows[:-1]:
        assert got[p] == brute_knn(rows, v, 7)


def test_knn_filters(spark):
    frame, rows = vectors(spark, 60, 0)
    queries = frame.limit(1).select(F.lit("q").alias("query_id"), "embedding")
    query = rows[0][2]
    top = brute_knn(rows, query, 10)
    kept = {p for p, s, _ in rows if s == "A"}
    post = ranked(dense.knn(frame, queries, 10, filter_source="A"))["q"]
    assert post == [h for h in top if h[0] in kept] and len(post) < 10
    pre = ranked(dense.knn(frame, queries, 10, filter_source="A", filter_mode="pre"))["q"]
    assert pre == brute_knn(rows, query, 10, ("A",)) and len(pre) == 10
    with pytest.raises(ValueError):
        dense.knn(frame, queries, 10, filter_mode="both")


def test_cell_search_recall(spark):
    frame, _ = vectors(spark, 400, 100)
    queries = frame.select(F.col("product_id").alias("query_id"), "embedding").limit(50)
    exact = ranked(dense.knn(frame, queries, 5))
    near = ranked(dense.knn_cells(frame, queries, 5, cells=8, probes=6, rows_per_block=30))
    shared = sum(len({s for _, s in exact[q]} & {s for _, s in near[q]}) / len({s for _, s in exact[q]}) for q in exact)
    assert shared / len(exact) >= 0.9
    everywhere = ranked(dense.knn_cells(frame, queries, 5, cells=8, probes=8, rows_per_block=30))
    assert everywhere == exact


def test_no_more_than_the_hits_leave_a_search_of_many_queries(spark, monkeypatch):
    """Queries that are as many as the products: what is ranked does not grow with blocks of one times blocks of the other."""
    frame, _ = vectors(spark, 400, 0)
    frame = frame.repartition(4)
    queries = frame.select(F.col("product_id").alias("query_id"), "embedding")
    ranked_rows = []
    own = dense.top_n
    monkeypatch.setattr(dense, "top_n", lambda df, *rest: (ranked_rows.append(df.count()), own(df, *rest))[1])
    exact = ranked(dense.knn(frame, queries, 5, chunk_bytes=500))
    cells = ranked(dense.knn_cells(frame, queries, 5, cells=8, probes=8, rows_per_block=30))
    codes = dense.code_table(frame, book := dense.train_codes(frame))
    near = ranked(dense.knn_codes(codes, book, frame, queries, 5, chunk_bytes=500))
    assert cells == exact and set(near) == set(exact)
    assert ranked_rows == [399 * 5] * 3


def run(spark, rows):
    return spark.createDataFrame(
        [(q, p, r, 1.0 / r, s) for q, p, r, s in rows], "query_id string, product_id string, rank long, score double, source string")


@pytest.mark.parametrize("n, dims", [(300, 8), (4000, 32)])
def test_codes_find_the_neighbours(spark, n, dims):
    own = np.random.default_rng(n)
    matrix = own.normal(size=(n, dims)) * np.linspace(2, 0.5, dims)
    matrix[0] = 0
    rows = [(f"p{i:05d}", "A" if i % 3 else "B", v.tolist()) for i, v in enumerate(matrix)]
    frame = spark.createDataFrame(rows, "product_id string, source string, embedding array<double>").repartition(3)
    queries = frame.filter("product_id < 'p00040'").select(F.col("product_id").alias("query_id"), "embedding")
    book = dense.train_codes(frame, rows=1000)
    codes = dense.code_table(frame, book)
    assert codes.count() == n - 1 and {len(r.code) for r in codes.collect()} == {dims // 4}
    exact = {(r.query_id, r.product_id): r.score for r in dense.knn(frame, queries, 10).collect()}
    found = {(r.query_id, r.product_id): r.score for r in dense.knn_codes(codes, book, frame, queries, 10, chunk_bytes=2000).collect()}
    assert len(exact) == len(found) == 390
    both = set(exact) & set(found)
    assert len(both) >= 0.9 * len(exact)
    assert all(abs(exact[p] - found[p]) < 2e-6 for p in both)
    with pytest.raises(ValueError, match="equal parts"):
        dense.train_codes(frame, parts=3)


def test_samples_are_bounded(spark):
    rows = spark.range(5000).select(F.col("id").cast("string").alias("product_id"))
    assert 300 < dense.sampled(rows, 500).count() < 700
    assert dense.sampled(rows, 5000).count() == 5000


def test_rrf(spark):
    first = run(spark, [("q", "a", 1, "x"), ("q", "b", 2, "x"), ("q", "", 3, "x")])
    second = run(spark, [("q", "b", 1, "x"), ("q", "c", 2, "x")])
    got = fusion.rrf([first, second], 10).orderBy("rank").collect()
    assert [r.product_id for r in got] == ["b", "a", "c"]
    assert got[0].score == round(1 / 62 + 1 / 61, 9)
    swapped = fusion.rrf([second, first], 10).orderBy("rank").collect()
    assert [tuple(r) for r in swapped] == [tuple(r) for r in got]


def test_candidate_union(spark):
    lexical_run = run(spark, [("q", "a", 1, "lex"), ("q", "b", 2, "lex")])
    dense_run = run(spark, [("q", "b", 1, "dense"), ("q", "c", 2, "dense")])
    got = fusion.candidates(lexical_run, dense_run).orderBy("leg", "rank").collect()
    assert [(r.product_id, r.source, r.score) for r in got] == [("a", "lex", 1.0), ("b", "dense", 1.0), ("c", "dense", 0.5)]


def test_pairwise_ties_keep_order(spark):
    found = spark.createDataFrame(
        [("q", "z", 0.1, "s", 0, 1, "red sofa", "red"), ("q", "a", 0.2, "s", 1, 1, "red sofa", "sofa"),
         ("q", "m", 0.3, "s", 1, 2, "red sofa", "red sofa")],
        "query_id string, product_id string, score double, source string, leg int, rank long, query string, text string")
    got = rerank.pairwise(found, models.word_overlap, 3).orderBy("rank").collect()
    assert [r.product_id for r in got] == ["m", "z", "a"]
    listed = rerank.listwise_prompts(found).withColumn("answer", F.lit("[3] > [1]"))
    order = rerank.listwise(listed, 2).orderBy("rank").collect()
    assert [(r.product_id, r.score) for r in order] == [("m", 0.3), ("z", 0.1)]
    none = rerank.listwise(rerank.listwise_prompts(found).withColumn("answer", F.lit(None).cast("string")), 3)
    assert [r.product_id for r in none.orderBy("rank").collect()] == ["z", "a", "m"]


def test_best_of_subqueries(spark):
    hits = spark.createDataFrame(
        [("q", 0, "a", "s", 0.5, 1), ("q", 0, "b", "s", 0.4, 2), ("q", 1, "b", "s", 0.9, 1), ("q", 1, "c", "s", 0.5, 2)],
        "query_id string, part int, product_id string, source string, score double, rank long")
    got = rerank.best_of_subqueries(hits, 3).orderBy("rank").collect()
    assert [(r.product_id, r.score) for r in got] == [("b", 0.9), ("a", 0.5), ("c", 0.5)]


def test_equal_texts_are_searched_once(spark, shop):
    queries = spark.createDataFrame([(f"q{i}", "hot w1") for i in range(50)] + [("z", "w2")], "query_id string, query string")
    texts, ids = distinct_texts(queries)
    assert texts.count() == 2 and ids.count() == 51
    hits = for_all(lexical.bm25(shop[1], texts, 3, BOOSTS), ids)
    got = ranked(hits)
    assert len(got) == 51 and got["q0"] == got["q49"]


@pytest.fixture(scope="module")
def search(spark, shop):
    rows, index = shop
    docs = spark.createDataFrame(rows, "product_id string, source string, title string, body string")
    encoded = docs.select("product_id", "source", models.bag_of_words(F.col("title")).alias("embedding"))
    return Search(index, encoded, docs.select("product_id", F.col("title").alias("text")), BOOSTS)


def test_strategies_with_injected_models(spark, search, tmp_path):
    queries = spark.createDataFrame([("q1", "hot w1 w2"), ("q2", "w3 w9")], "query_id string, query string")

    def load_scores():
        return lambda asked, texts: [float(len(set(q.split()) & set(t.split()))) for q, t in zip(asked, texts)]

    def load_vectors():
        return lambda texts: [[float(t.count(w)) + 0.01 for w in ("w1", "w2", "w3", "hot")] for t in texts]

    def reverse_order():
        def answer(prompts_):
            return ["[2] > [1]" for _ in prompts_]
        return answer

    answers = str(tmp_path / "answers")
    mine = search.with_models(
        score=models.pair_scorer(load_scores), encode=models.encoder(load_vectors),
        rank=lambda rows: models.ask(rows, reverse_order, answers),
        title=lambda rows: rows.withColumn("answer", F.lit("w1 thing\nsecond line")),
    )
    docs = spark.createDataFrame(collection(300), "product_id string, source string, title string, body string")
    from dataclasses import replace
    mine = replace(mine, vectors=docs.select("product_id", "source", mine.models.encode(F.col("title")).alias("embedding")))
    for result in (mine.hybrid_rrf(queries, 5), mine.hybrid_rerank(queries, 5), mine.hyde_rerank(queries, 5),
                   mine.hybrid_listwise(queries, 5, 10), mine.hyde_listwise(queries, 5, 10)):
        got = ranked(result)
        assert set(got) == {"q1", "q2"} and all(len(v) == 5 for v in got.values())
    plain = ranked(mine.with_models(rank=lambda rows: rows.withColumn("answer", F.lit(None).cast("string"))).hybrid_listwise(queries, 3, 10))
    swapped = ranked(mine.hybrid_listwise(queries, 3, 10))
    assert [p for p, _ in swapped["q1"]][:2] == [p for p, _ in plain["q1"]][:2][::-1]


def test_each_prompt_is_asked_once(spark, tmp_path):
    log = tmp_path / "calls"
    log.write_text("")
    answers = str(tmp_path / "answers")

    def load():
        def answer(texts):
            with open(log, "a") as out:
                out.writelines(f"{t}\n" for t in texts)
            if any(t == "bad" for t in texts):
                raise RuntimeError("no answer")
            return [t.upper() for t in texts]
        return answer

    rows = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", "bad")], "id string, prompt string")
    for _ in range(2):
        got = {r.id: r.answer for r in models.ask(rows, load, answers, batch=1).collect()}
        assert got == {"a": "X", "b": "X", "c": "Y", "d": None}
    calls = log.read_text().split()
    assert calls.count("x") == 1 and calls.count("y") == 1 and calls.count("bad") == 2


def test_lists_are_not_copied_for_each_query(spark, search, tmp_path, monkeypatch):
    """Queries of one text share its written lists; their metrics, and the lists kept by query, are those of copies."""
    written = {}
    keep = benchmark.materialize

    def seen(frame, name):
        kept = keep(frame, name)
        written[name] = kept.count()
        return kept

    monkeypatch.setattr(benchmark, "materialize", seen)
    asked = [(f"q{i:02d}", ("hot w1 w2", "w3 w9", "w5 w6 w7")[i % 3]) for i in range(60)]
    queries = spark.createDataFrame(asked, "query_id string, query string")
    rng = random.Random(3)
    judged = [(q, f"p{p:04d}", float(rng.randint(1, 3))) for q, _ in asked[:50] for p in rng.sample(range(300), 40)]
    qrels = spark.createDataFrame(judged, "query_id string, product_id string, gain double")
    options = {"depth": 10, "strategies": ["bm25", "knn", "hybrid_rrf", "agentic"], "limit_generative": 20}
    found = benchmark.benchmark(search, queries, qrels, [3, 10], folder=str(tmp_path), **options).collect()
    runs = benchmark.run_strategies(search, queries, **options)
    assert found == evaluation.evaluate(qrels, runs, [3, 10]).collect() and any(r.score > 0 for r in found)
    assert written["runs"] <= 3 * 4 * 10 < runs.count()
    lists = spark.read.option("wholetext", True).text(str(tmp_path / "bm25_ranked")).collect()
    assert sum(r.value.count('"q') for r in lists) == 60
