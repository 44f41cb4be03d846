"""Whitening against a plain eigendecomposition, and its rank-one updates by themselves."""

import numpy as np
import pytest

from flowcascade.llm import whitening
from flowcascade.llm.common import prepare_session
from flowcascade.llm.queries import QUERIES
from flowcascade.llm.spectrum import Spectrum, rank_one, secular_roots

DATA = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, x long, component int, `n.` string"


def table(spark, vectors):
    prepare_session(spark)
    rows = [(i, v, 1, 2, "z") for i, v in vectors]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def check(spark, vectors, got, components=16):
    """The contract, computed plainly."""
    good = [(i, v) for i, v in vectors
            if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v]
                  for _, v in good])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = (n * fit - sums) / n
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, int((values > x.shape[1] * 2.3e-16 * values[0]).sum()))
    want = ((n * x - sums) / n) @ axes[:, :k] / np.sqrt(values[:k])
    rows = sorted(got, key=lambda r: (r["vec_id"] is None, r["vec_id"] or 0, r["component"]))
    order = sorted(range(len(good)), key=lambda j: (good[j][0] is None, good[j][0] or 0))
    assert len(rows) == k * len(good)
    assert [r["vec_id"] for r in rows] == [good[j][0] for j in order for _ in range(k)]
    assert [r["component"] for r in rows] == [*range(1, k + 1)] * len(good)
    assert {r["n"] for r in rows} == {n}
    deviation = ((n * x - sums) ** 2).sum(1)
    assert [r["deviation"] for r in rows] == [int(deviation[j]) for j in order for _ in range(k)]
    explained = np.array([r["explained"] for r in rows]).reshape(-1, k)
    assert np.allclose(explained, values[:k] / values.sum(), rtol=1e-9)
    assert {r["identity_error"] for r in rows}.pop() < 1e-9
    found = np.array([r["whitened"] for r in rows]).reshape(-1, k)
    return found, want[order]


def assert_same_up_to_sign(found, want):
    sign = np.sign((found * want).sum(0))
    assert np.abs(found * sign - want).max() < 1e-8


def test_query_on_a_given_table(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    got = QUERIES["op11_embedding_whitening"](spark, DATA).collect()
    assert_same_up_to_sign(*check(spark, [(r["vec_id"], r["embedding"]) for r in rows], got))


def sample(rng, n, width):
    return (rng.normal(size=(n, width)) * np.arange(1, width + 1)).round(3).tolist()


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, v) for i, v in enumerate(sample(rng, 300, 5))]
    vectors += [(7, vectors[7][1])] * 200 + [(None, vectors[9][1]), (None, vectors[9][1])]
    vectors += [(900, None), (901, []), (902, [1.0, None, 1.0, 1.0, 1.0]),
                (903, [float("nan")] * 5), (904, [1.0, 2.0, 3.0, 4.0, float("inf")])]
    got = whitening.whiten_embeddings(table(spark, vectors)).collect()
    repeats = [r for r in got if r["vec_id"] == 7]
    assert len(repeats) == 201 * 5 and len({tuple(r) for r in repeats}) == 5
    single = vectors[:300] + vectors[-5:]
    assert_same_up_to_sign(*check(spark, single, [
        *{tuple(r): r for r in got if r["vec_id"] is not None}.values()]))
    assert sum(r["vec_id"] is None for r in got) == 10


def test_other_lengths_are_dropped(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, v) for i, v in enumerate(sample(rng, 40, 3))]
    got = whitening.whiten_embeddings(table(spark, vectors + [(99, [1.0, 2.0])])).collect()
    assert_same_up_to_sign(*check(spark, vectors, got))


def test_components_without_variance_are_left_out(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, [v[0], v[1], v[0], 2.0]) for i, v in enumerate(sample(rng, 50, 2))]
    got = whitening.whiten_embeddings(table(spark, vectors)).collect()
    assert max(r["component"] for r in got) == 2
    assert_same_up_to_sign(*check(spark, vectors, got))


@pytest.mark.parametrize("vectors", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0])] * 5])
def test_nothing_varies(spark, vectors):
    assert whitening.whiten_embeddings(table(spark, vectors)).collect() == []


def test_extreme_entries_do_not_crash(spark):
    vectors = [(i, [3e38 if i % 2 else -3e38, float(i)]) for i in range(6)]
    got = whitening.whiten_embeddings(table(spark, vectors)).collect()
    assert {r["vec_id"] for r in got} == set(range(6))
    assert all(np.isfinite(r["whitened"]) for r in got)


def test_large_deviations_are_exact():
    w = whitening.Whitener(10 ** 9, np.array([5 * 10 ** 8 + 3, -7]), np.ones(2), np.eye(2), 2.0)
    x = np.array([[whitening.SHIFT + 3, whitening.SHIFT - 2]])
    want = (3 * 10 ** 9 - 5 * 10 ** 8 - 3) ** 2 + (-2 * 10 ** 9 + 7) ** 2
    assert want > 1 << 63 and w.deviations(x) == [None]
    x = np.array([[whitening.SHIFT + 2, whitening.SHIFT]])
    assert w.deviations(x) == [(2 * 10 ** 9 - 5 * 10 ** 8 - 3) ** 2 + 49]


@pytest.mark.parametrize("block_rows", [1, 3, 1000])
@pytest.mark.parametrize("kind", ["normal", "whole", "repeated", "flat"])
def test_updates_equal_a_decomposition(block_rows, kind):
    rng = np.random.default_rng(4)
    for width in (1, 2, 7, 16):
        rows = rng.integers(-50, 50, (60, width))
        if kind == "whole":
            rows = rng.integers(-1, 2, (60, width))
        elif kind == "repeated":
            rows = np.repeat(rows[:5], 6, axis=0)
        elif kind == "flat":
            rows[:, width // 2:] = 3
        both = []
        for part in (rows, rows[:20], rows[20:]):
            s = Spectrum(width)
            for at in range(0, len(part), block_rows):
                s.add_rows(part[at:at + block_rows])
            both.append(s)
        both[1].add(both[2])
        centred = rows - rows.mean(0)
        for s in both[:2]:
            assert s.n == len(rows) and (s.sums == rows.sum(0)).all()
            assert np.allclose(s.mean, rows.mean(0))
            assert np.abs(s.vectors.T @ s.vectors - np.eye(width)).max() < 1e-12
            made = s.vectors @ np.diag(s.values) @ s.vectors.T
            assert np.abs(made - centred.T @ centred).max() < 1e-10 * max(
                np.abs(centred.T @ centred).max(), 1)


def test_secular_roots_lie_between_poles():
    poles = np.array([0.0, 1e-9, 1.0, 1.0 + 1e-12, 50.0])
    for weights in (np.full(5, 1e-3), np.array([1e-14, 1.0, 1e6, 1e-3, 1e-8])):
        roots, distance = secular_roots(poles, weights)
        assert (roots >= poles).all() and (roots[:-1] <= poles[1:]).all()
        assert (np.diag(distance) < 0).all()
        assert np.allclose(distance, poles[:, None] - roots, atol=1e-12)


def test_deflated_update_changes_nothing_else():
    values, vectors = np.array([1.0, 2.0, 5.0]), np.eye(3)
    found, turned = rank_one(values, vectors, np.array([0.0, 2.0, 0.0]))
    assert np.allclose(found, [1, 5, 6]) and np.allclose(
        turned @ np.diag(found) @ turned.T, np.diag([1.0, 6.0, 5.0]))
    assert rank_one(values, vectors, np.zeros(3))[0] is values
