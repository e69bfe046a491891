"""Sparse non-negative stain factors against planted vectors and a dense solution by numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from slidelake.operators import pixels as P


def planted(spark, seed=1, n=1500):
    r = np.random.default_rng(seed)
    h = np.array([[0.65, 0.70, 0.29], [0.07, 0.99, 0.11]])
    h /= np.linalg.norm(h, axis=1, keepdims=True)
    w = r.exponential(0.8, (n, 2)) * (r.uniform(size=(n, 2)) < 0.6)
    od = np.clip(w @ h + r.normal(0, 0.01, (n, 3)), 0.0, 5.0)
    rgb = np.exp(-od)
    df = spark.createDataFrame([("t", k, 0, *map(float, v)) for k, v in enumerate(rgb)], "tile_id string, row int, col int, r double, g double, b double")
    return h, od, df


def dense(od, h, sparsity, rounds):
    """Each pixel's amounts by trying both, either and none; then the same multiplicative steps."""
    costs = []
    for _ in range(rounds):
        p, g = od @ h.T - sparsity, h @ h.T
        best, w = np.zeros(len(od)), np.zeros((len(od), 2))
        both = p @ np.linalg.inv(g)
        for cand in (both, np.column_stack([p[:, 0], 0 * p[:, 0]]), np.column_stack([0 * p[:, 1], p[:, 1]])):
            value = np.einsum("ij,ij->i", cand, p) - 0.5 * np.einsum("ij,jk,ik->i", cand, g, cand)
            ok = (cand >= 0).all(axis=1) & (value > best)
            best, w[ok] = np.where(ok, value, best), cand[ok]
        costs.append(0.5 * ((od - w @ h) ** 2).sum() + sparsity * w.sum())
        for _ in range(20):
            h = h * (w.T @ od) / np.maximum(w.T @ w @ h, 1e-12)
        h = h / np.linalg.norm(h, axis=1, keepdims=True)
    return costs


def test_planted_vectors_are_found_and_cost_falls(spark):
    h, od, df = planted(spark)
    found = P.estimated_basis(df, "vahadane", passes=40)
    for k in range(2):
        assert found[:, k] @ h[k] > 0.998
    assert np.linalg.norm(found, axis=0) == pytest.approx([1, 1, 1])
    start = np.array([[0.5, 0.7, 0.5], [0.3, 0.9, 0.3]])
    kept = od[od.max(axis=1) > 0.15]
    rows = spark.createDataFrame([tuple(map(float, v)) for v in kept], "or double, og double, ob double")
    got, costs = P.factorised(rows, start, passes=12)
    assert len(costs) > 3 and all(b < a for a, b in zip(costs, costs[1:]))
    want = dense(kept, start / np.linalg.norm(start, axis=1, keepdims=True), 0.05, len(costs))
    assert costs == pytest.approx(want, rel=1e-6)
    assert (got >= 0).all()


def test_without_tissue_and_unknown_methods(spark):
    _, _, df = planted(spark, n=20)
    white = df.limit(0)
    assert np.allclose(P.estimated_basis(white, "vahadane"), P.basis(P.HEMATOXYLIN, P.EOSIN))
    with pytest.raises(ValueError):
        P.estimated_basis(df, "other")
    # one colour alone has no two stains
    flat = df.withColumns({c: F.lit(v) for c, v in zip("rgb", (0.5, 0.3, 0.6))})
    with pytest.raises(ValueError):
        P.estimated_basis(flat, "vahadane", passes=5)
