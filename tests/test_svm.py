"""Spatial refinement by support vector machines against the dual problem solved pair by pair."""

import numpy as np
import pytest

from slidelake.operators import svm


def dual(x, sign, gamma, cost):
    """Decision values at the training points, by sequential minimal optimisation to a small tolerance."""
    k = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    q, alpha, grad = k * np.outer(sign, sign), np.zeros(len(x)), -np.ones(len(x))
    for _ in range(200_000):
        up = ((alpha < cost) & (sign > 0)) | ((alpha > 0) & (sign < 0))
        low = ((alpha < cost) & (sign < 0)) | ((alpha > 0) & (sign > 0))
        f = -sign * grad
        i, j = np.where(up)[0][f[up].argmax()], np.where(low)[0][f[low].argmin()]
        if f[i] - f[j] < 1e-7:
            break
        room_i = cost - alpha[i] if sign[i] > 0 else alpha[i]
        room_j = alpha[j] if sign[j] > 0 else cost - alpha[j]
        t = min((f[i] - f[j]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12), room_i, room_j)
        for at, way in ((i, sign[i] * t), (j, -sign[j] * t)):
            alpha[at] += way
            grad += q[:, at] * way
    return k @ (alpha * sign) + (f[i] + f[j]) / 2


def brute(xy, labels, gamma=0.5, cost=1.0):
    """Votes and whether a decision was too near to call."""
    x = (xy - xy.mean(axis=0)) / xy.std(axis=0, ddof=1)
    names = sorted(set(labels))
    votes, near = np.zeros((len(x), len(names)), dtype=int), np.zeros(len(x), dtype=bool)
    for i, a in enumerate(names):
        for j in range(i + 1, len(names)):
            mine = np.isin(labels, [a, names[j]])
            sign = np.where(labels[mine] == a, 1.0, -1.0)
            k = np.exp(-gamma * ((x[:, None] - x[None, mine]) ** 2).sum(axis=2))
            at = dual(x[mine], sign, gamma, cost)
            value = np.linalg.lstsq(np.column_stack([k[mine], np.ones(mine.sum())]), at, rcond=1e-12)[0]
            every = np.column_stack([k, np.ones(len(x))]) @ value
            near |= np.abs(every) < 0.02
            votes[:, i] += every > 0
            votes[:, j] += every <= 0
    return np.asarray(names)[votes.argmax(axis=1)], near


def noisy(seed, n, classes):
    r = np.random.default_rng(seed)
    xy = r.uniform(0, 1000, (n, 2))
    pure = np.floor(xy[:, 0] / 1000 * classes).astype(int) if classes > 2 else (np.hypot(xy[:, 0] - 500, xy[:, 1] - 500) < 300).astype(int)
    drawn = np.where(r.random(n) < 0.1, r.integers(0, classes, n), pure)
    return xy, np.asarray([f"c{v}" for v in drawn])


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, sample string, x double, y double, label string")


@pytest.mark.parametrize("block", [20_000, 70])
def test_machines_equal_the_dual(spark, block):
    """In one task and in parts, pass by pass."""
    xy, labels = noisy(5, 200, 2)
    rows = [(i, "s", float(a), float(b), str(v)) for i, ((a, b), v) in enumerate(zip(xy, labels, strict=True))]
    got = {r["id"]: r["refined"] for r in svm.refine_labels(frame(spark, rows), by=["sample"], block=block).collect()}
    want, near = brute(xy, labels)
    assert len(got) == 200 and near.sum() < 20
    assert all(got[i] == want[i] for i in range(200) if not near[i])
    assert sum(want != labels) > 5


def test_three_labels_and_several_samples(spark):
    xy, labels = noisy(6, 240, 3)
    rows = [(i, "s", float(a), float(b), str(v)) for i, ((a, b), v) in enumerate(zip(xy, labels, strict=True))]
    rows += [(1000, "one", 1.0, 1.0, "only"), (1001, "one", 2.0, 5.0, None), (1002, "one", 2.0, 5.0, None), (1003, None, 3.0, 3.0, None), (1004, "null", 3.0, 3.0, "x")]
    got = {r["id"]: r["refined"] for r in svm.refine_labels(frame(spark, rows), by=["sample"]).collect()}
    want, near = brute(xy, labels)
    assert all(got[i] == want[i] for i in range(240) if not near[i]) and near.sum() < 40
    assert [got[k] for k in (1000, 1001, 1002, 1003, 1004)] == ["only", "only", "only", None, "x"]


def test_features_give_the_kernel():
    r = np.random.default_rng(1)
    x = np.vstack([r.normal(0, 1, (100, 2)), [[9.0, -7.0]]])
    for gamma in (0.5, 2.0):
        step = 0.5 / np.sqrt(2 * gamma)
        shape = {"mx": 0.0, "my": 0.0, "sx": 1.0, "sy": 1.0, "cx": np.unique(np.floor(x[:, 0] / step)), "cy": np.unique(np.floor(x[:, 1] / step))}
        phi = svm.features(shape, gamma, x[:, 0], x[:, 1])[:, :-1]
        assert np.abs(phi @ phi.T - np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(axis=2))).max() < 1e-5


def test_one_place_with_two_labels_an_empty_table_and_broken_rows(spark):
    same = [(i, "s", 4.0, 4.0, "a" if i < 3 else "b") for i in range(5)]
    got = svm.refine_labels(frame(spark, same)).collect()
    assert len(got) == 5 and {r["refined"] for r in got} == {"a"}
    assert svm.refine_labels(frame(spark, [])).collect() == []
    with pytest.raises(Exception, match="finite"):
        svm.refine_labels(frame(spark, [(1, "s", float("nan"), 1.0, "a")])).collect()
    with pytest.raises(ValueError, match="refined"):
        svm.refine_labels(frame(spark, same).withColumnRenamed("id", "refined"))


def test_query_against_the_dual(spark):
    from slidelake.plans import queries, views

    sf = "/root/testdata/sf0.001"
    got = {r["point_id"]: r for r in queries.QUERIES["n31_refine_labels"](spark, sf).collect()}
    at = {r["point_id"]: (r["x"], r["y"]) for r in views.points(spark, sf).select("point_id", "x", "y").collect()}
    assert set(got) == set(at)
    for slide in sorted({r["slide_id"] for r in got.values()}):
        ids = sorted(k for k, r in got.items() if r["slide_id"] == slide)
        want, near = brute(np.array([at[k] for k in ids]), np.array([got[k]["label"] for k in ids]))
        assert all(got[k]["refined"] == w for k, w, n in zip(ids, want, near, strict=True) if not n)
        assert near.mean() < 0.2


def test_passes_over_parts_are_few(spark, monkeypatch):
    """They begin at the optimum of one part: every pass over a large sample is a round of jobs."""
    rounds = []
    monkeypatch.setattr(svm, "written", lambda df, name, of=svm.written: (rounds.append(name), of(df, name))[1])
    xy, labels = noisy(7, 300, 2)
    rows = [(i, "s", float(a), float(b), str(v)) for i, ((a, b), v) in enumerate(zip(xy, labels, strict=True))]
    whole = {r["id"]: r["refined"] for r in svm.refine_labels(frame(spark, rows), by=["sample"]).collect()}
    assert "svm_state" not in rounds
    parts = {r["id"]: r["refined"] for r in svm.refine_labels(frame(spark, rows), by=["sample"], block=150).collect()}
    assert sum(parts[k] != whole[k] for k in whole) <= 3
    assert 2 < rounds.count("svm_state") < 32
