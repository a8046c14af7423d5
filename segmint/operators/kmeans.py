"""K-means of many starts at once.

All (k, restart) runs go through the points together: a pass computes the
distances to the centres of every run that still moves, and gives one sum for
each centre and task, added up before the shuffle. The number of passes is
that of the slowest run, whatever the number of runs. Starts are chosen by
k-means++ in as many passes as the largest k has centres, by an exponential
race over squared distances whose draws hash the point, the run and the
centre.

Points lie in balls (``density.ball_blocks``). Where the second nearest centre
is farther from a ball's centre than the nearest by more than its diameter,
all its points belong to the nearest, and its stored sums are added without a
look at the points.

Late steps move centres little. A point whose second nearest centre is farther
than its nearest by more than twice the ``room`` of a run keeps its centre while
no centre is farther than ``room`` from where the pass found it. A pass over
calm runs tells the sums of those points and the few others one by one, and one
task a run then makes steps until a centre has left its room: the same steps,
many a pass. Points are also counted by their margin; the next room is the
largest power of two that leaves few of them loose.

Only the centres are on the driver and go to the tasks: runs x k x dimensions
numbers, given by the parameters.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import at_once, ensure_checkpoint_dir, written
from .density import BLOCK_ROWS, SLACK, _value, ball_blocks, of_copies
from .tiles import column, distinct_points, matrix

MAX_STEPS, TOLERANCE = 300, 1e-4
PART = "run int, c int, n double, cost double, s array<double>"
#: A run is calm once a step moves no centre by more than this share of the
#: root mean square distance of the points to their centres.
CALM = 0.02
#: Calm runs of a pass. More are dealt to several passes at the same time.
TOGETHER = 32
#: Loose points of a run and of all runs in a pass, about.
LOOSE, LOOSE_ALL = 1 << 14, 1 << 17
#: The least power of two that margins are counted by, and how many powers.
LOW, POWERS = -20, 40
#: What a row of a pass over calm runs tells: the sums of a centre, a loose
#: point, points by margin, or that the loose points of a task were too many.
SUMS, POINT, COUNTS, MANY = range(4)


@dataclass
class Run:
    k: int
    seed: int
    centres: np.ndarray
    cost: float = float("inf")
    moving: bool = True
    steps: int = 0
    moved: float = float("inf")  # the farthest that the last step moved a centre
    room: float = 0.0  # how far the steps of one pass may go


def _blocks_of(batches):
    """(points, weights, ids, centre, radius) of each ball in Arrow batches."""
    for b in batches:
        take = lambda n, k: b.column(b.schema.get_field_index(n))[k]
        for k in range(b.num_rows):
            x = _value(take("x", k), "x").reshape(take("m", k).as_py(), take("d", k).as_py())
            yield x, _value(take("w", k), "w"), _value(take("ids", k), "ids"), _value(take("c", k), "c"), take("r", k).as_py()


def _squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    d = (x * x).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2.0 * (x @ centres.T)
    return np.maximum(d, 0.0)


class Balls:
    """The points of a fit: balls of distinct points in a checkpoint, moved to
    the mean of all points so that distances lose no digits."""

    def __init__(self, points: DataFrame, block_rows: int = BLOCK_ROWS):
        from pyspark.ml.functions import array_to_vector
        from pyspark.ml.stat import Summarizer

        ensure_checkpoint_dir(points.sparkSession)
        self.points = points
        row = points.agg(Summarizer.mean(array_to_vector("x")).alias("m"), F.count(F.lit(1)).alias("n")).first()
        self.n, self.mean = row["n"], row["m"].toArray()
        self.singles = distinct_points(points).transform(written)
        # a few centres tell coarse balls apart as well as fine ones
        self.blocks = ball_blocks(self.singles, block_rows, rounds=1)

    def starts(self, ks_seeds: list[tuple[int, int]]) -> list[Run]:
        """k-means++ for every (k, seed), all runs a centre at a time."""
        import pyarrow as pa

        runs = [Run(k, seed, np.empty((0, len(self.mean)))) for k, seed in ks_seeds]
        mean, sc = self.mean, self.blocks.sparkSession.sparkContext
        for step in range(max(k for k, _ in ks_seeds)):
            open_ = [(i, r.seed, r.centres) for i, r in enumerate(runs) if r.k > step]
            shared = sc.broadcast(open_)

            def race(batches, shared=shared, step=step):
                best: dict[int, tuple] = {}
                for x, w, ids, _, _ in _blocks_of(batches):
                    x = x - mean
                    for i, seed, centres in shared.value:
                        d = w if not step else w * _squared(x, centres).min(1)
                        with np.errstate(divide="ignore"):
                            key = np.where(d > 0, -np.log(_draw(ids, seed, step)) / d, np.inf)
                        k = int(key.argmin())
                        if i not in best or (key[k], ids[k]) < best[i][:2]:
                            best[i] = (float(key[k]), int(ids[k]), x[k])
                if best:
                    cols = zip(*[(i, *v) for i, v in best.items()])
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.float64(), pa.int64(), pa.list_(pa.float64())))], names=["run", "key", "id", "x"])

            told = self.blocks.mapInArrow(race, "run int, key double, id long, x array<double>")
            for r in told.groupBy("run").agg(F.min_by("x", F.struct("key", "id")).alias("x")).collect():  # a row a run
                runs[r["run"]].centres = np.vstack([runs[r["run"]].centres, r["x"]])
            shared.destroy()
        for r in runs:
            r.centres = r.centres + mean
        return runs

    def step(self, runs: list[Run]) -> None:
        """One step of Lloyd's for all runs that move: new centres and the
        cost of the old ones. A centre without points stays."""
        import pyarrow as pa

        mean = self.mean
        moving = [i for i, r in enumerate(runs) if r.moving]
        shared = self.blocks.sparkSession.sparkContext.broadcast([(i, runs[i].centres - mean) for i in moving])

        def sums(batches):
            # runs of equal k together, as arrays (k, runs, dimensions)
            groups = []
            for k in sorted({len(c) for _, c in shared.value}):
                some = [(i, c) for i, c in shared.value if len(c) == k]
                centres = np.stack([c for _, c in some], 1)
                groups.append(([i for i, _ in some], centres, np.zeros((*centres.shape[:2], centres.shape[2] + 1)), np.zeros(len(some))))
            for x, w, _, c, r in _blocks_of(batches):
                x, c = x - mean, c - mean
                whole, weight = (w[:, None] * x).sum(0), w.sum()
                squares = w * (x * x).sum(1)
                inner = float((w * ((x - c) ** 2).sum(1)).sum())
                ones = np.column_stack([x, np.ones(len(x))])
                for _, centres, total, cost in groups:
                    k, runs_, dims = centres.shape
                    far = np.sqrt(_squared(c[None, :], centres.reshape(-1, dims))[0]).reshape(k, runs_)
                    order = np.partition(far, 1, axis=0) if k > 1 else np.vstack([far, np.full(runs_, np.inf)])
                    lone = order[1] - order[0] > 2 * r * (1 + SLACK) + SLACK
                    if lone.any():
                        at = np.flatnonzero(lone)
                        near = far[:, at].argmin(0)
                        own = centres[near, at]
                        total[near, at] += np.r_[whole, weight]
                        offset = 2.0 * (c - own) @ (whole - weight * c)
                        cost[at] += inner + weight * ((c - own) ** 2).sum(1) + offset
                    if lone.all():
                        continue
                    at = np.flatnonzero(~lone)
                    some = centres[:, at]
                    # distances less the squares of the points, centre by centre
                    sides = np.concatenate([-2.0 * some, (some * some).sum(2)[:, :, None]], 2)
                    d = (sides.reshape(-1, dims + 1) @ ones.T).reshape(k, len(at), len(x))
                    least, near = d[0].copy(), np.zeros(d[0].shape, np.int8 if k < 128 else np.int64)
                    for j in range(1, k):
                        near[d[j] < least] = j
                        np.minimum(least, d[j], out=least)
                    for j in range(k):  # the distances give way to the weights of each centre's points
                        np.multiply(near == j, w, out=d[j])
                    total[:, at] += (d.reshape(-1, len(x)) @ ones).reshape(k, len(at), dims + 1)
                    cost[at] += least @ w + squares.sum()
            rows = []
            for ids, _, total, cost in groups:
                for j, c in np.argwhere(total[:, :, -1] > 0).tolist():
                    rows.append((ids[c], j, total[j, c, -1], 0.0, total[j, c, :-1]))
                # the cost of a run goes with its first centre that has points
                first = (total[:, :, -1] > 0).argmax(0)
                rows += [(i, int(j), 0.0, v, np.zeros(total.shape[2] - 1)) for i, j, v in zip(ids, first, np.maximum(cost, 0.0)) if total[j, ids.index(i), -1] > 0]
            if rows:
                kinds = (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], names=["run", "c", "n", "cost", "s"])

        from pyspark.ml.functions import array_to_vector, vector_to_array
        from pyspark.ml.stat import Summarizer

        parts = self.blocks.mapInArrow(sums, PART)
        total = parts.groupBy("run", "c").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s"))
        found = total.collect()  # a row a centre
        shared.destroy()
        for i in moving:
            runs[i].cost = 0.0
        before = {i: runs[i].centres.copy() for i in moving}
        for r in found:
            runs[r["run"]].cost += r["cost"]
            runs[r["run"]].centres[r["c"]] = np.asarray(r["s"]) / r["n"] + mean
        for i in moving:
            runs[i].steps += 1
            runs[i].moved = _farthest(runs[i].centres, before[i])
            runs[i].moving = runs[i].moved > TOLERANCE

    def steps(self, runs: list[Run], max_steps: int) -> None:
        """Steps of Lloyd's in one pass for calm runs: at least one, and on as
        long as the centres stay within their room, to ``max_steps`` in all."""
        import pyarrow as pa

        mean = self.mean
        most = max(2, min(LOOSE, LOOSE_ALL // len(runs)))
        shared = self.blocks.sparkSession.sparkContext.broadcast([(r.centres - mean, r.room, max_steps - r.steps) for r in runs])
        kinds = {"run": pa.int32(), "kind": pa.int32(), "c": pa.int32(), "n": pa.float64(), "s": pa.list_(pa.float64())}

        def rows(run, kind, c, n, s):
            m, width = s.shape
            ends = pa.array(np.arange(m + 1) * width, pa.int32())
            cols = (np.full(m, run), np.full(m, kind), c, n)
            arrays = [pa.array(v, t) for v, t in zip(cols, kinds.values())]
            return pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(ends, pa.array(s.ravel()))], names=list(kinds))

        def parts(batches):
            held = [Part(centres, room, most // 2) for centres, room, _ in shared.value]
            for x, w, _, c, r in _blocks_of(batches):
                x, c = x - mean, c - mean
                ones = np.column_stack([x, np.ones(len(x))])
                squares = (x * x).sum(1)
                whole = w @ ones
                for part in held:
                    part.add(ones, w, squares, whole, c, r)
            for i, part in enumerate(p.close() for p in held):
                k = len(part.centres)
                yield rows(i, SUMS, np.arange(k), part.total[:, -1], part.total[:, :-1])
                yield rows(i, COUNTS, [0], [0.0], part.counts[None, :])
                if part.many:
                    yield rows(i, MANY, [0], [0.0], np.zeros((1, 0)))
                for ones, w in part.loose:
                    yield rows(i, POINT, np.zeros(len(w)), w, ones[:, :-1])

        def walk(key, t):
            run = key[0].as_py()
            centres, room, left = shared.value[run]
            k = len(centres)
            kind, n = column(t, "kind"), column(t, "n")
            of = lambda what: t.filter(pa.array(kind == what))
            own, fixed = column(of(SUMS), "c"), np.zeros((k, centres.shape[1] + 1))
            np.add.at(fixed, own, np.column_stack([matrix(of(SUMS), "s"), n[kind == SUMS]]))
            counts = matrix(of(COUNTS), "s").sum(0)
            w, loose, many = n[kind == POINT], of(POINT), bool((kind == MANY).any())
            ones = np.column_stack([matrix(loose, "s"), np.ones(len(w))]) if len(w) else np.zeros((0, centres.shape[1] + 1))
            now, steps = centres, 0
            while True:
                near = _sides(now, ones).argmin(0)
                total = fixed + ((np.arange(k)[:, None] == near) * w) @ ones
                with_points = total[:, -1] > 0
                new = now.copy()
                new[with_points] = total[with_points, :-1] / total[with_points, -1:]
                moved, now, steps = _farthest(new, now), new, steps + 1
                if many or not moved > TOLERANCE or steps == left or _farthest(now, centres) > room:
                    break
            few = np.flatnonzero(np.cumsum(counts) <= most / 2)
            wide = 2.0 ** (few[-1] + LOW - 1) if len(few) else 0.0
            if room:  # balls with a wider margin were not counted point by point
                wide = min(wide, room / 4 if many else room * 4)
            wide = wide if wide > TOLERANCE else 0.0
            return pa.table({"run": pa.array([run], pa.int32()), "steps": pa.array([steps], pa.int32()), "moved": [moved], "room": [wide], "x": pa.array([now.ravel()], pa.list_(pa.float64()))})

        told = self.blocks.mapInArrow(parts, "run int, kind int, c int, n double, s array<double>")
        found = told.groupBy("run").applyInArrow(walk, "run int, steps int, moved double, room double, x array<double>").collect()  # a row a run
        shared.destroy()
        for r in found:
            run = runs[r["run"]]
            run.centres = np.array(r["x"]).reshape(run.centres.shape) + mean
            run.steps += r["steps"]
            run.moved, run.room, run.moving = r["moved"], r["room"], r["moved"] > TOLERANCE

    def calm(self, run: Run) -> bool:
        return np.isfinite(run.moved) and run.moved <= CALM * np.sqrt(run.cost / self.n)

    def fit(self, runs: list[Run], max_steps: int = MAX_STEPS) -> list[Run]:
        """Steps until no run moves any centre by more than ``TOLERANCE``, or
        ``max_steps``; the cost is then that of the last centres."""
        going = lambda some: [r for r in some if r.moving and r.steps < max_steps]
        while wild := [r for r in going(runs) if not self.calm(r)]:
            self.step(wild)

        def end(some):
            while some := going(some):
                self.steps(some, max_steps)

        calm = going(runs)
        groups = -(-len(calm) // TOGETHER)
        if groups:
            at_once(self.blocks.sparkSession, *[partial(end, calm[i::groups]) for i in range(groups)])
        last = [Run(r.k, r.seed, r.centres.copy()) for r in runs]
        self.step(last)
        for r, x in zip(runs, last):
            r.cost = x.cost
        return runs

    def nearest(self, runs: dict[str, Run]) -> DataFrame:
        """(id, a column of labels for every named run): the nearest centre of
        each distinct point, the first of equally near ones."""
        import pyarrow as pa

        mean = self.mean
        held = [(n, r.centres - mean) for n, r in runs.items()]

        def near(batches):
            for x, _, ids, _, _ in _blocks_of(batches):
                cols = [pa.array(_squared(x - mean, c).argmin(1), pa.int32()) for _, c in held]
                yield pa.RecordBatch.from_arrays([pa.array(ids), *cols], names=["id", *runs])

        return self.blocks.mapInArrow(near, "id long, " + ", ".join(f"{n} int" for n in runs))

    def labels(self, runs: dict[str, Run]) -> DataFrame:
        """(pid, the columns of ``nearest``) of every point."""
        return of_copies(self.points, self.singles, self.nearest(runs)).drop("id")


class Part:
    """What a task finds of one calm run: sums of the points that keep their
    centre, and the loose points, of which it holds ``most``."""

    def __init__(self, centres: np.ndarray, room: float, most: int):
        self.centres, self.room, self.most = centres, room, most
        self.squares = (centres * centres).sum(1)
        self.total = np.zeros((len(centres), centres.shape[1] + 1))
        self.counts = np.zeros(POWERS)
        self.loose, self.apart = [], np.zeros_like(self.total)
        self.many, self.n = False, 0

    def add(self, ones: np.ndarray, w: np.ndarray, squares: np.ndarray, whole: np.ndarray, c: np.ndarray, r: float) -> None:
        """Takes a ball in: its points (and a column of ones), weights, squares,
        sums, centre and radius."""
        k = len(self.centres)
        far = np.sqrt(_squared(c[None, :], self.centres)[0])
        two = np.partition(far, 1)[:2] if k > 1 else (far[0], np.inf)
        if two[1] - two[0] > 2 * (r + self.room) * (1 + SLACK) + SLACK:
            self.total[far.argmin()] += whole
            return
        d = _sides(self.centres, ones)
        near = d.argmin(0)
        least, second = d[0].copy(), np.full(len(w), np.inf)
        for j in range(1, k):
            np.minimum(second, np.maximum(least, d[j]), out=second)
            np.minimum(least, d[j], out=least)
        # no more than the true margin: differences of squares, less what rounding can add
        error = 64 * np.finfo(float).eps * (squares + self.squares.max())
        sides = np.sqrt(np.maximum(least + squares, 0.0) + error) + np.sqrt(np.maximum(second + squares, 0.0) + error)
        margin = np.maximum(second - least - error, 0.0) / np.where(sides > 0, sides, 1.0) if k > 1 else np.full(len(w), np.inf)
        power = np.frexp(np.minimum(margin, 2.0 ** (LOW + POWERS)))[1] - LOW
        self.counts += np.bincount(np.where(margin > 0, power, 0).clip(0, POWERS - 1), minlength=POWERS)
        free = margin <= 2 * self.room * (1 + SLACK) if self.room else np.zeros(len(w), bool)
        if free.any():
            some, weights, own = ones[free], w[free], near[free]
            self.n += len(own)
            if self.n > self.most:
                self.many, self.loose = True, []
            else:
                self.loose.append((some, weights))
            self.apart += ((np.arange(k)[:, None] == own) * weights) @ some
            ones, w, near = ones[~free], w[~free], near[~free]
        self.total += ((np.arange(k)[:, None] == near) * w) @ ones

    def close(self) -> Part:
        """With too many loose points all points count for where they are."""
        if self.many:
            self.total += self.apart
        return self


def _sides(centres: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """(centre, point): squared distances less the squares of the points, which
    have a column of ones."""
    return np.column_stack([-2.0 * centres, (centres * centres).sum(1)]) @ ones.T


def _farthest(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.sqrt(((a - b) ** 2).sum(1).max()))


def _draw(ids: np.ndarray, seed: int, step: int) -> np.ndarray:
    """Uniform numbers in (0, 1) from a hash of (id, seed, step)."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 1_000_003 + step + 1) & 0xFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return ((h >> np.uint64(11)).astype(float) + 0.5) / 2.0**53
