"""Components and whitened rows beside numpy's eigenvectors over all rows."""

import numpy as np
import pytest

from siftrank.llm import whitening
from siftrank.llm.queries import QUERIES


def expected(vectors, components=4):
    x = np.floor(256 * np.asarray(vectors, dtype=np.float64)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1][:, :components]
    white = (x - sums / n) @ axes / np.sqrt(values[:components])
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
    return n, deviation, white, values[:components] / values.sum()


def check(found, ids, vectors, components=4, exact=1e-9):
    n, deviation, white, shares = expected(vectors, components)
    by_id = {}
    for r in found:
        by_id.setdefault(r.vec_id, []).append(r)
    got = np.array([[r.whitened for r in sorted(by_id[i], key=lambda r: r.component)] for i in ids])
    turn = np.sign((got * white).sum(axis=0))
    assert np.abs(got - white * turn).max() < exact
    for i, d in zip(ids, deviation):
        assert {(r.n, r.deviation) for r in by_id[i]} == {(n, d)}
        assert [r.component for r in sorted(by_id[i], key=lambda r: r.component)] == list(range(1, components + 1))
    for r in found:
        assert r.explained == pytest.approx(shares[r.component - 1], rel=1e-9)
        assert r.identity_error < 1e-9


def test_registered_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    rows = [r for r in rows if r.embedding is not None and np.isfinite(np.array(r.embedding, dtype=float)).all()]
    check(QUERIES["op12_whitening"](spark, sf).collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


def frame(spark, vectors, ids=None):
    ids = ids or list(range(len(vectors)))
    return spark.createDataFrame([(i, v, "x", 0) for i, v in zip(ids, vectors)], "vec_id long, embedding array<double>, x string, n int")


def test_copies_weigh_nothing_and_odd_rows_go(spark):
    own = np.random.default_rng(3)
    vectors = [v.tolist() for v in own.normal(size=(60, 6)) * [5, 4, 3, 2, 1, 0.5]]
    kept = vectors + [vectors[0]] * 40
    odd = [None, [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] + [0.0] * 5, [float("-inf")] + [0.0] * 5, [1.0] * 5, []]
    found = whitening.whiten(frame(spark, kept + odd).repartition(7)).collect()
    assert {r.vec_id for r in found} == set(range(len(kept)))
    check(found, list(range(len(kept))), kept)


def test_far_from_zero_and_of_very_unequal_spread(spark):
    own = np.random.default_rng(4)
    vectors = [v.tolist() for v in own.normal(size=(300, 4)) * [1000, 30, 1, 0.02] + [1e6, -1e6, 5e5, 0]]
    check(whitening.whiten(frame(spark, vectors)).collect(), list(range(300)), vectors, exact=1e-6)


def test_directions_without_spread_are_no_components(spark):
    own = np.random.default_rng(5)
    flat = np.round(own.normal(size=(50, 2)) * 8)
    vectors = [[a, b, a + b, 7.0, 2 * a] for a, b in flat.tolist()]
    found = whitening.whiten(frame(spark, vectors)).collect()
    assert {r.component for r in found} == {1, 2}
    check(found, list(range(50)), vectors, components=2)
    assert whitening.whiten(frame(spark, [[1.0, 2.0]] * 5)).count() == 0
    assert whitening.whiten(frame(spark, [[1.0, 2.0]]).limit(0)).count() == 0
    fewer = whitening.whiten(frame(spark, [[1.0, 2.0], [3.0, 5.0], [4.0, 1.0]], [4, None, 4]))
    assert sorted(str(r.vec_id) for r in fewer.collect()) == ["4"] * 4 + ["None"] * 2


def test_deviations_beyond_a_product_of_longs(spark):
    centre = whitening.Centre(3_000_000, np.array([3_000_001, -5], dtype=np.int64))
    x = np.array([[900, -4], [1, 0]], dtype=np.int64)
    assert centre.deviation(x).tolist() == [sum((3_000_000 * a - s) ** 2 for a, s in zip(row, [3_000_001, -5])) for row in x.tolist()]
    with pytest.raises(OverflowError):
        whitening.Centre(3_000_000_000, np.array([0, 0])).deviation(x)


def test_merging_in_levels_gives_the_same(spark, monkeypatch):
    from siftrank.llm import common

    own = np.random.default_rng(6)
    vectors = [v.tolist() for v in own.normal(size=(90, 3))]
    monkeypatch.setattr(common, "FAN", 3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check(whitening.whiten(frame(spark, vectors).repartition(11), components=3).collect(), list(range(90)), vectors, components=3)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
