"""Exact k-distance and DBSCAN against NumPy brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from segmint.operators.density import dbscan, kth_neighbor_distance


def _points(spark, x):
    return spark.createDataFrame([(int(i), x[i].tolist()) for i in range(len(x))], "pid long, x array<double>")


def _brute_dbscan(x, eps, min_samples):
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    near = d <= eps
    core = near.sum(1) >= min_samples
    n = len(x)
    comp = -np.ones(n, dtype=int)
    for i in range(n):  # components of the core graph, named by smallest id
        if core[i] and comp[i] < 0:
            stack, comp[i] = [i], i
            while stack:
                u = stack.pop()
                for v in np.where(near[u] & core)[0]:
                    if comp[v] < 0:
                        comp[v] = i
                        stack.append(v)
    ids = sorted(set(comp[core]))
    number = {c: j for j, c in enumerate(ids)}
    lab = -np.ones(n, dtype=int)
    for i in range(n):
        if core[i]:
            lab[i] = number[comp[i]]
        else:
            cand = np.where(near[i] & core)[0]
            if len(cand):
                best = cand[np.lexsort((cand, d[i, cand]))[0]]
                lab[i] = number[comp[best]]
    return lab


def test_kth_distance_matches_brute(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(c, 0.5, size=(60, 6)) for c in (0, 3)] + [rng.uniform(-5, 8, size=(20, 6))])
    got = dict(kth_neighbor_distance(_points(spark, x), k=5, block_rows=40).collect())
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    want = np.sort(d, axis=1)[:, 4]
    assert len(got) == len(x)
    for i in range(len(x)):
        assert got[i] == pytest.approx(want[i], rel=1e-9)


@pytest.mark.parametrize("eps", [0.8, 1.3])
def test_dbscan_matches_brute(spark, eps):
    rng = np.random.default_rng(9)
    x = np.vstack([rng.normal(c, 0.4, size=(70, 4)) for c in (0, 2.5, 6)] + [rng.uniform(-3, 9, size=(30, 4))])
    res = dbscan(_points(spark, x), eps, 5, block_rows=50)  # small blocks force salting
    got = dict(res.labels.collect())
    want = _brute_dbscan(x, eps, 5)
    assert [got[i] for i in range(len(x))] == want.tolist()


def test_dbscan_sweep_matches_brute_for_each_eps(spark):
    from segmint.operators.density import dbscan_sweep

    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(c, 0.5, size=(60, 3)) for c in (0, 3)] + [rng.uniform(-2, 5, size=(25, 3))])
    eps_list = [0.5, 0.8, 1.2]
    results = dbscan_sweep(_points(spark, x), eps_list, 5, block_rows=40)
    for eps, res in zip(eps_list, results):
        got = dict(res.labels.collect())
        assert [got[i] for i in range(len(x))] == _brute_dbscan(x, eps, 5).tolist(), eps


def test_within_equals_all_pairs():
    from segmint.operators.tiles import within

    rng = np.random.default_rng(1)
    for scale in (1.0, 1e-14, 1e14):
        a, b = rng.normal(size=(90, 5)) * scale, rng.normal(size=(70, 5)) * scale
        b[:9] = a[:9]
        d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
        for limit in (np.full(90, scale), np.zeros(90), np.full(90, np.inf), rng.random(90) * 3 * scale):
            got = [np.concatenate(v) for v in zip(*within(a, b, limit))] or [np.empty(0, int)] * 3
            assert set(zip(got[0].tolist(), got[1].tolist())) == set(zip(*(v.tolist() for v in np.nonzero(d <= limit[:, None]))))
            assert np.allclose(got[2], d[got[0], got[1]], rtol=1e-12)


def test_blocks_are_numbered_so_that_groups_are_full(spark):
    from segmint.operators.density import ball_blocks
    from segmint.operators.tiles import distinct_points

    x = np.random.default_rng(2).normal(size=(400, 3))
    blocks = ball_blocks(distinct_points(_points(spark, x).repartition(7)), 20).collect()
    assert sorted(b["bid"] for b in blocks) == list(range(len(blocks))) and sum(b["m"] for b in blocks) == 400


def test_a_written_table_has_its_true_size(spark):
    from segmint.session import written

    df = spark.range(100).toDF("a")
    for _ in range(6):  # a checkpoint's estimate is squared by every join
        df = df.join(df.withColumnRenamed("a", "b"), df["a"] + 1 > F.col("b") + 99).select("a").transform(written)
    size = str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    assert int(size) < 1_000_000


@pytest.mark.parametrize("eps", [0.3, 3.0])
def test_dbscan_of_copies_and_of_all_linked_blocks(spark, eps):
    rng = np.random.default_rng(12)
    x = np.round(np.vstack([rng.normal(c, 0.5, size=(80, 2)) for c in (0, 9)] + [rng.uniform(-6, 15, size=(20, 2))]), 1)
    got = dict(dbscan(_points(spark, x), eps, 5, block_rows=30).labels.collect())
    assert [got[i] for i in range(len(x))] == _brute_dbscan(x, eps, 5).tolist()
