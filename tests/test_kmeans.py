"""K-means of many starts against a plain loop."""

import numpy as np

from segmint.operators.kmeans import Balls, Run


def lloyd(x, centres, steps):
    for _ in range(steps):
        near = ((x[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
        centres = np.array([x[near == c].mean(0) if (near == c).any() else centres[c] for c in range(len(centres))])
    d = ((x[:, None] - centres[None]) ** 2).sum(-1)
    return centres, d.min(1).sum(), d.argmin(1)


def points(seed=1):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, 0.5, (60, 3)) for c in (0, 5, 11, 300)])
    return np.concatenate([x, x[:20], x[:20]])


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "pid long, x array<double>").checkpoint()


def test_steps_equal_a_plain_loop(spark):
    x = points()
    balls = Balls(frame(spark, x), block_rows=16)
    runs = [Run(k, 0, x[:k * 40:40].copy()) for k in (1, 2, 3, 5)]
    balls.fit(runs, max_steps=3)
    told = {r["pid"]: r for r in balls.labels({f"k{r.k}": r for r in runs}).collect()}
    assert len(told) == len(x)
    for r in runs:
        centres, cost, near = lloyd(x, x[:r.k * 40:40].copy(), 3)
        assert np.allclose(r.centres, centres) and np.isclose(r.cost, cost)
        assert [told[i][f"k{r.k}"] for i in range(len(x))] == near.tolist()


def test_sweep_finds_separate_groups_and_does_not_depend_on_partitions(spark):
    x = points()
    fits = []
    for parts in (2, 5):
        balls = Balls(frame(spark, x).repartition(parts), block_rows=32)
        runs = balls.fit(balls.starts([(k, s) for k in (3, 4) for s in range(3)]))
        assert all(not r.moving for r in runs) and all(r.centres.shape == (r.k, 3) for r in runs)
        fits.append(runs)
    for a, b in zip(*fits):
        assert np.allclose(a.centres, b.centres) and a.steps == b.steps
    best = min((r for r in fits[0] if r.k == 4), key=lambda r: r.cost)
    assert np.isclose(best.cost, lloyd(x, best.centres, 0)[1])
    assert sorted(round(c[0]) for c in best.centres) == [0, 5, 11, 300]


def test_many_runs_of_equal_k_over_blocks_of_bytes(spark):
    x = points(3)
    balls = Balls(frame(spark, x), block_rows=24)
    assert dict(balls.blocks.dtypes)["x"] == "binary"  # not a number at a time between Spark and Python
    starts = {(k, s): x[np.random.default_rng(s).permutation(len(x))[:k]].copy() for k in (1, 2, 4) for s in range(3)}
    runs = balls.fit([Run(k, s, c.copy()) for (k, s), c in starts.items()], max_steps=2)
    for r in runs:
        centres, cost, _ = lloyd(x, starts[r.k, r.seed], 2)
        assert np.allclose(r.centres, centres) and np.isclose(r.cost, cost)


def cloud(n=900, seed=5):
    """One blob: many steps, many points near two centres."""
    return np.random.default_rng(seed).normal(size=(n, 3))


def ends(x, centres):
    """Centres and number of steps of a plain loop that ends as a fit does."""
    for steps in range(1, 301):
        new = lloyd(x, centres, 1)[0]
        moved, centres = np.sqrt(((new - centres) ** 2).sum(1).max()), new
        if moved <= 1e-4:
            break
    return centres, steps


def test_late_steps_go_many_a_pass(spark, monkeypatch):
    from segmint.operators import kmeans

    x = cloud()
    balls = Balls(frame(spark, x), block_rows=128)
    monkeypatch.setattr(kmeans, "CALM", 0.2, raising=False)
    passes = []
    plain = Balls.step

    def counted(self, runs):
        passes.append(len(runs))
        return plain(self, runs)

    monkeypatch.setattr(Balls, "step", counted)
    if hasattr(Balls, "steps"):
        late = Balls.steps
        monkeypatch.setattr(Balls, "steps", lambda self, runs, most: (passes.append(len(runs)), late(self, runs, most)))
    starts = {k: x[: 7 * k : 7].copy() for k in (1, 4, 6)}
    runs = balls.fit([Run(k, 0, c.copy()) for k, c in starts.items()])
    for r in runs:
        centres, steps = ends(x, starts[r.k])
        assert np.allclose(r.centres, centres) and r.steps == steps and not r.moving
        assert np.isclose(r.cost, lloyd(x, r.centres, 0)[1])
    assert max(r.steps for r in runs) > 20 and len(passes) < 0.7 * max(r.steps for r in runs)


def test_too_many_loose_points_take_one_step(spark, monkeypatch):
    from segmint.operators import kmeans

    x = np.concatenate([cloud(300), cloud(300)[:40]])
    balls = Balls(frame(spark, x), block_rows=64)
    start = x[:40:8].copy()
    monkeypatch.setattr(kmeans, "LOOSE", 4)
    run = Run(5, 0, start.copy(), room=100.0)  # every point is loose
    balls.steps([run], 300)
    assert run.steps == 1 and run.moving and run.room < 100.0
    assert np.allclose(run.centres, lloyd(x, start, 1)[0])
    monkeypatch.undo()
    run = Run(5, 0, start.copy(), room=100.0)
    balls.steps([run], 7)  # no more than asked for
    assert run.steps == 7 and np.allclose(run.centres, lloyd(x, start, 7)[0])
