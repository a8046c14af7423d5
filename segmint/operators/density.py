"""Density operators: exact k-th-neighbour distances (ε candidates) and
DBSCAN over balls of near points.

**Blocks.** Equal points are one weighted point. A cell of too many points is
split by some of its own points as pivots, each point going to the nearest,
until cells are small. A block is a cell with its centre and radius and is
stored once, as one row. By the triangle inequality two blocks can hold points
within ε only if their centres are no farther than ε and both radii; only
such pairs of block ids are formed. Near blocks lie in one group of blocks, a
task takes a pair of groups, and each block comes to it once. There are
``SIDES`` groups until they hold ``GROUP`` blocks each, so that the copies of a
block do not grow with the table.

**Work that is left out.** A product in single precision rules out pairs
beyond the limit, others are measured (``tiles.within``). The k-th distance
within the own block bounds the search of every point, and what a task finds
bounds it further. A point that its own block proves to be a core point is not
counted further, nor is any point beyond ``min_samples``; blocks of settled
points only meet no other for counting. Linking measures a pair once for all ε:
it counts from the first ε at which both are core points and near. Groups find
their own components first; pairs of groups tell only a forest between those,
and blocks whose components are linked already meet for border points only.

Exact ε-neighbourhoods of points in one blob of high dimension have no index
that avoids their pairs; there the work is still quadratic, in bounded tasks.

**Components.** Min-label propagation with pointer jumping over the forest
edges, each round checkpointed (reliable checkpoint folder), until no
label changes. Border points join the cluster of their nearest core point
(ties: smaller id); clusters are numbered 0.. by their smallest core id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, written
from .tiles import column, distances, distinct_points, fresh, matrix, meet, meet_all, of_singles, within

#: Points of a block, at most twice as many where pivots split badly.
BLOCK_ROWS = 1024
#: Pivots that split a cell at once, rounds of splitting.
PIVOTS, ROUNDS = 32, 8
#: Groups of blocks, and blocks of a group at most; ids of the blocks of a
#: group follow each other.
SIDES, GROUP = 16, 64
#: Edges that a task collects before it joins their components.
EDGES = 1 << 20
#: Slack of the bounds for rounding errors.
SLACK = 1e-9


# --------------------------------------------------------------------------- blocks
def ball_blocks(points: DataFrame, rows: int = BLOCK_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """(bid, m, d, ids, w, x, c, r) from distinct (id, n, x) points: blocks
    with ids, weights and coordinates (numbers one after another as bytes),
    centre and radius; bid counts from 0, near blocks follow each other.
    ``points`` should be a written table; the result is one."""
    import pyarrow as pa

    from .ranking import OrderIndex

    cells = points.withColumn("cell", F.lit(0).cast("long"))

    def split(key, p, q):
        if not p.num_rows or not q.num_rows:
            return pa.schema([("id", pa.int64()), ("n", pa.float64()), ("x", pa.list_(pa.float64())), ("cell", pa.int64())]).empty_table()
        near = np.concatenate([d.argmin(1) for _, d in distances(matrix(p), matrix(q), squared=True)])
        child = column(p, "cell") * PIVOTS + column(q, "k")[near]
        return pa.table({"id": p.column("id"), "n": p.column("n"), "x": p.column("x").cast(pa.list_(pa.float64())), "cell": pa.array(child, pa.int64())})

    for _ in range(rounds):
        big = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > rows).transform(written)
        if big.isEmpty():
            break
        order = Window.partitionBy("cell").orderBy(F.xxhash64("id"), "id")
        # the pivots are the first by hash; a few times as many go into the order
        few = F.xxhash64("id") / F.lit(2.0**63) <= F.lit(6.0 * PIVOTS) / F.col("m") - 1.0
        pivots = cells.join(big, "cell").where(few).withColumn("k", F.row_number().over(order)).where((F.col("k") <= PIVOTS) & (F.col("k") <= F.ceil(2 * F.col("m") / rows)))
        moved = meet(cells.join(big.select("cell"), "cell", "left_semi"), pivots.select("cell", "id", "x", "k"), ["cell"], F.col("id"), F.col("id"), split, "id long, n double, x array<double>, cell long", 8192)
        cells = cells.join(big.select("cell"), "cell", "left_anti").select("id", "n", "x", "cell").unionByName(moved).transform(written)
    sizes = cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / (2 * rows)).cast("int").alias("parts"))
    dealt = cells.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))

    def block(t):
        x = matrix(t)
        c = x.mean(0)
        flat = lambda v, kind: pa.array([np.ascontiguousarray(v, kind).tobytes()])
        return pa.table({
            "bid": t.column("bid")[:1], "m": pa.array([len(x)], pa.int32()), "d": pa.array([x.shape[1]], pa.int32()), "ids": flat(column(t, "id"), np.int64),
            "w": flat(column(t, "n"), float), "x": flat(x, float), "c": pa.array([c]), "r": pa.array([float(np.sqrt(((x - c) ** 2).sum(1)).max()) * (1 + SLACK)]),
        })

    named = OrderIndex(dealt.select("cell", "part").distinct(), ["cell", "part"])  # a row a block
    numbers = named.with_position("bid").withColumn("bid", F.col("bid") - 1)
    schema = "bid long, m int, d int, ids binary, w binary, x binary, c array<double>, r double"
    made = dealt.join(numbers, ["cell", "part"]).groupBy("bid").applyInArrow(block, schema)
    n = max(1, named.count())
    # enough parts for many tasks, each of some blocks
    return made.repartition(max(min(n, 24), min(96, n // 8), n // 64)).transform(written)


def near_blocks(blocks: DataFrame, reach: Column, wanted: Column | None = None) -> DataFrame:
    """(i, j) with i <= j: blocks whose points may lie within the larger of
    their ``reach``. With ``wanted``, only pairs of which a block is wanted."""
    import pyarrow as pa

    stats = blocks.select("bid", F.col("c").alias("x"), "r", reach.cast("double").alias("reach"), (F.lit(True) if wanted is None else wanted).alias("wanted"))
    n = blocks.count()

    def fn(key, p, q):
        out = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        if p.num_rows and q.num_rows:
            a, b, ra, rb = column(p, "bid"), column(q, "bid"), column(p, "r"), column(q, "r")
            ea, eb = column(p, "reach"), column(q, "reach")
            wa, wb = (t.column("wanted").to_numpy() for t in (p, q))
            for lo, d in distances(matrix(p), matrix(q)):
                part = slice(lo, lo + len(d))
                near = d * (1 - SLACK) <= ra[part, None] + rb[None, :] + np.maximum(ea[part, None], eb[None, :])
                i, j = np.nonzero(near & (a[part, None] <= b[None, :]) & (wa[part, None] | wb[None, :]))
                out.append((a[part][i], b[j]))
        i, j = (np.concatenate(v) for v in zip(*out))
        return pa.table({"i": pa.array(i, pa.int64()), "j": pa.array(j, pa.int64())})

    return meet_all(stats, stats, n, n, F.col("bid"), F.col("bid"), fn, "i long, j long")


class Block:
    """A block in a task."""

    def __init__(self, table, k: int):
        self.row = row = {n: _value(table.column(n)[k], n) for n in table.schema.names}
        self.bid, self.c, self.r = row["bid"], row["c"], row["r"]
        self.ids, self.w, self.x = row["ids"], row["w"], row["x"].reshape(row["m"], row["d"])

    def near(self, other: Block, reach) -> np.ndarray:
        """Rows that may have a point of ``other`` within ``reach``."""
        if other is self:
            return np.arange(len(self.ids))
        d = np.sqrt(((self.x - other.c) ** 2).sum(1))
        return np.flatnonzero(d * (1 - SLACK) <= other.r + reach)


BYTES = {"ids": np.int64, "w": float, "x": float}
ARRAYS = {"c", "u", "own", "core", "comp"}


def _value(scalar, name: str):
    if name in BYTES:
        return np.frombuffer(scalar.as_buffer(), BYTES[name])
    return scalar.values.to_numpy(zero_copy_only=False) if name in ARRAYS else scalar.as_py()


def group_size(blocks: DataFrame) -> int:
    return max(1, min(GROUP, -(-blocks.count() // SIDES)))


def on_pairs(blocks: DataFrame, pairs: DataFrame, columns: list[str], fn, schema: str) -> DataFrame:
    """``fn(blocks by id, pairs)`` -> Arrow table, for the pairs of two groups
    of blocks at a time."""
    size = group_size(blocks)
    told = pairs.withColumn("gi", F.expr(f"i div {size}")).withColumn("gj", F.expr(f"j div {size}"))
    told = told.transform(written)
    need = told.select("gi", "gj", F.explode(F.array("i", "j")).alias("bid")).distinct()
    # blocks are wide: never all of them to every task
    data = need.join(blocks.select("bid", "m", "d", "ids", "w", "x", "c", "r", *columns).hint("merge"), "bid")

    def run(key, t, p):
        t = t.combine_chunks()
        held = {b.bid: b for b in (Block(t, k) for k in range(t.num_rows))}
        return fn(held, sorted(zip(p.column("i").to_pylist(), p.column("j").to_pylist())))

    return data.groupBy("gi", "gj").cogroup(fresh(told).groupBy("gi", "gj")).applyInArrow(run, schema)


def with_column(blocks: DataFrame, ddl: str, fn) -> DataFrame:
    """``blocks`` with further columns, made by ``fn(Block)`` -> values."""
    import pyarrow as pa

    names = [f.split()[0] for f in ddl.split(", ")]

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                one = b.slice(k, 1)
                yield pa.RecordBatch.from_arrays([*one.columns, *(pa.array([v]) for v in fn(Block(one, 0)))], names=[*one.schema.names, *names])

    return blocks.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.schema) + ", " + ddl)


# --------------------------------------------------------------------------- k-distance
def _least(d: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k least distances of each row, ascending, with their weights."""
    at = np.argpartition(d, min(k, d.shape[1]) - 1, axis=1)[:, :k] if d.shape[1] > k else np.tile(np.arange(d.shape[1]), (len(d), 1))
    by = np.take_along_axis(d, at, 1).argsort(1, kind="stable")
    at = np.take_along_axis(at, by, 1)
    return np.take_along_axis(d, at, 1), np.take_along_axis(np.broadcast_to(w, d.shape), at, 1)


def _kth(d: np.ndarray, w: np.ndarray, k: int) -> np.ndarray:
    """The distance at which k points are reached; infinite if they are not."""
    reached = np.cumsum(w, 1) >= k
    return np.where(reached.any(1), d[np.arange(len(d)), reached.argmax(1)], np.inf)


def kth_neighbor_distance(points: DataFrame, k: int = 5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(pid, kd): exact distance from every (pid, x) point to its k-th nearest
    point, counting the point itself (scikit-learn ``kneighbors`` on the
    fitted data)."""
    import pyarrow as pa

    ensure_checkpoint_dir(points.sparkSession)
    n = points.count()
    if n < k:
        raise ValueError(f"need at least {k} points, got {n}")
    singles = distinct_points(points).transform(written)

    def bound(b: Block):
        u = np.concatenate([_kth(*_least(d, b.w, k), k) for _, d in distances(b.x, b.x)]) * (1 + SLACK)
        return u, float(u.max())

    blocks = with_column(ball_blocks(singles, block_rows), "u array<double>, reach double", bound).transform(written)

    def fn(held, pairs):
        best: dict[int, tuple] = {}
        for i, j in pairs:
            for a, b in ((held[i], held[j]), (held[j], held[i]))[: 1 if i == j else 2]:
                if a.bid not in best:
                    m = len(a.ids)
                    best[a.bid] = np.full((m, k), np.inf), np.ones((m, k)), a.row["u"].copy()
                have, weight, bound = best[a.bid]
                rows = a.near(b, bound)
                for p, q, d in within(a.x[rows], b.x, bound[rows]):
                    _merge(have, weight, rows[p], d, b.w[q])
                bound[rows] = np.minimum(bound[rows], _kth(have[rows], weight[rows], k) * (1 + SLACK))
        ids, counts, dist, weights = ([np.empty(0, t)] for t in (np.int64, np.int64, float, float))
        for bid, (have, weight, _) in best.items():
            told = np.isfinite(have)
            some = told.any(1)
            ids.append(held[bid].ids[some])
            counts.append(told[some].sum(1))
            dist.append(have[told])
            weights.append(weight[told])
        ends = pa.array(np.cumsum(np.r_[0, np.concatenate(counts)]), pa.int32())
        lists = lambda v: pa.ListArray.from_arrays(ends, pa.array(np.concatenate(v)))
        return pa.table({"id": pa.array(np.concatenate(ids)), "d": lists(dist), "w": lists(weights)})

    parts = on_pairs(blocks, near_blocks(blocks, F.col("reach")), ["u"], fn, "id long, d array<double>, w array<double>")
    # at most k values for each group that a point meets
    least = F.slice(F.array_sort(F.flatten(F.collect_list("v"))), 1, k).alias("v")
    merged = parts.select("id", F.arrays_zip("d", "w").alias("v")).groupBy("id").agg(least)
    step = lambda acc, e: F.when(acc["n"] >= k, acc).otherwise(F.struct((acc["n"] + e["w"]).alias("n"), e["d"].alias("d")))
    kd = F.aggregate("v", F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("d")), step)["d"]
    return of_copies(points, singles, merged.select("id", kd.alias("kd"))).select("pid", "kd").transform(written)


def _merge(have: np.ndarray, weight: np.ndarray, at: np.ndarray, d: np.ndarray, w: np.ndarray) -> None:
    """Puts the distances d, weights w of the rows ``at`` among the least of
    each row, in place."""
    rows, k = np.unique(at), have.shape[1]
    at = np.r_[at, np.repeat(rows, k)]
    d, w = np.r_[d, have[rows].ravel()], np.r_[w, weight[rows].ravel()]
    order = np.lexsort((d, at))
    at, d, w = at[order], d[order], w[order]
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    rank = np.arange(len(at)) - np.repeat(starts, np.diff(np.r_[starts, len(at)]))
    keep = rank < k
    have[at[keep], rank[keep]], weight[at[keep], rank[keep]] = d[keep], w[keep]


def of_copies(points: DataFrame, singles: DataFrame, found: DataFrame) -> DataFrame:
    """The columns found for distinct points, for every point."""
    return of_singles(points.select("pid", "x"), singles, found).drop("x")


def eps_candidates(kdist: DataFrame, percentiles=(70, 75, 80, 85, 90, 92, 95)) -> list[float]:
    from .ranking import exact_quantiles

    q = exact_quantiles(kdist, ["kd"], [p / 100.0 for p in percentiles], "pid")
    vals = sorted({round(float(q[("kd", p / 100.0)]), 4) for p in percentiles})
    return vals


# --------------------------------------------------------------------------- DBSCAN
@dataclass
class DbscanResult:
    eps: float
    labels: DataFrame
    n_clusters: int
    n_noise: int
    singles: DataFrame | None = None  # (id, n, x, dbscan_label): the distinct points


def _components_np(n: int, ea: np.ndarray, eb: np.ndarray) -> np.ndarray:
    """Min-index label of each of n nodes over undirected edges (NumPy label
    propagation with pointer jumping; a block holds ≤ ~2·block_rows nodes)."""
    lab = np.arange(n)
    if len(ea) == 0:
        return lab
    while True:
        old = lab.copy()
        m = np.minimum(lab[ea], lab[eb])
        np.minimum.at(lab, ea, m)
        np.minimum.at(lab, eb, m)
        lab = lab[lab]  # pointer jumping
        if np.array_equal(lab, old):
            return lab


def _components(edges: DataFrame, vertices: DataFrame, key: list[str], salts: int = 16) -> DataFrame:
    """``key`` columns + comp: the smallest vertex of the component, by label
    propagation with pointer jumping until nothing changes. ``vertices`` has
    the columns ``key`` (its last one is the vertex), ``edges`` the leading
    ones and a, b. Pointers are followed by (label, salt), so the one label
    of a giant component spreads over ``salts`` tasks."""
    *lead, v = key
    both = edges.select(*lead, F.col("a").alias("u"), F.col("b").alias("w")).unionByName(edges.select(*lead, F.col("b").alias("u"), F.col("a").alias("w")))
    labels = vertices.select(*lead, F.col(v).alias("v"), F.col(v).alias("l")).transform(written)
    salt = F.array(*[F.lit(i) for i in range(salts)])
    while True:
        nb = both.join(labels.select(*lead, F.col("v").alias("w"), "l"), [*lead, "w"]).groupBy(*lead, F.col("u").alias("v")).agg(F.min("l").alias("m"))
        step = labels.join(nb, [*lead, "v"], "left").select(*lead, "v", F.least("l", F.coalesce("m", "l")).alias("l")).transform(written)
        used = step.select(*lead, "l").distinct()
        target = used.join(step.select(*lead, F.col("v").alias("l"), F.col("l").alias("t")), [*lead, "l"]).withColumn("s", F.explode(salt))
        jump = step.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int")).join(target, [*lead, "l", "s"], "left")
        new = jump.select(*lead, "v", F.least("l", F.coalesce("t", "l")).alias("l")).transform(written)
        old = labels.select(*lead, "v", F.col("l").alias("o"))
        if new.join(old, [*lead, "v"]).where("l <> o").isEmpty():
            return new.select(*lead, F.col("v").alias(v), F.col("l").alias("comp"))
        labels = new


class Nodes:
    """The points of the blocks of a task by ascending id, and from which ε on
    each is a core point (``ne``: never)."""

    def __init__(self, held: dict, ne: int):
        ids = np.concatenate([b.ids for b in held.values()])
        order = np.argsort(ids)
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        cuts = np.cumsum([0, *(len(b.ids) for b in held.values())])
        self.ids = ids[order]
        self.at = {bid: place[lo:hi] for bid, lo, hi in zip(held, cuts[:-1], cuts[1:])}
        core = np.concatenate([b.row["core"].reshape(-1, ne) for b in held.values()])[order].T
        self.core = np.ascontiguousarray(core)
        self.first = np.where(core.any(0), core.argmax(0), ne)
        self.ne = ne

    def alone(self) -> np.ndarray:
        return np.tile(np.arange(len(self.ids)), (self.ne, 1))

    def known(self, held: dict) -> np.ndarray:
        """The components that groups found for themselves."""
        root = self.alone()
        for bid, b in held.items():
            comp = b.row["comp"].reshape(-1, self.ne).T
            root[:, self.at[bid]] = np.where(comp >= 0, np.searchsorted(self.ids, comp), root[:, self.at[bid]])
        return root


class Forest:
    """The smallest node of the component of each node, for each ε; an edge
    counts from its ε on. Edges wait until they are many."""

    def __init__(self, root: np.ndarray):
        self.root, self.waiting, self.n = root, [], 0

    def add(self, u: np.ndarray, v: np.ndarray, level: np.ndarray) -> None:
        new = self.root[level, u] != self.root[level, v]
        if new.any():
            self.waiting.append((u[new], v[new], level[new]))
            self.n += int(new.sum())
            if self.n > EDGES:
                self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        u, v, level = (np.concatenate(c) for c in zip(*self.waiting))
        for e, root in enumerate(self.root):
            a, b = root[u[level <= e]], root[v[level <= e]]
            apart = a != b
            if apart.any():
                root[:] = _components_np(len(root), a[apart], b[apart])[root]
        self.waiting, self.n = [], 0


class Border:
    """The nearest core point (ties: smaller node) of each node, by the ε from
    which on it counts."""

    def __init__(self, n: int, ne: int):
        self.d, self.q = np.full(n * ne, np.inf), np.zeros(n * ne, np.int64)
        self.ne = ne

    def add(self, p: np.ndarray, q: np.ndarray, d: np.ndarray, level: np.ndarray) -> None:
        at = p * self.ne + level
        order = np.lexsort((q, d, at))
        at, q, d = at[order], q[order], d[order]
        one = np.r_[True, at[1:] != at[:-1]][: len(at)]
        at, q, d = at[one], q[one], d[one]
        less = (d < self.d[at]) | ((d == self.d[at]) & (q < self.q[at]))
        self.d[at[less]], self.q[at[less]] = d[less], q[less]

    def told(self, nodes: Nodes) -> tuple:
        """(ε, node, its core point, distance) where the node is not core."""
        d, q = self.d.reshape(-1, self.ne).copy(), self.q.reshape(-1, self.ne).copy()
        for e in range(1, self.ne):
            less = (d[:, e - 1] < d[:, e]) | ((d[:, e - 1] == d[:, e]) & (q[:, e - 1] < q[:, e]))
            d[less, e], q[less, e] = d[less, e - 1], q[less, e - 1]
        v, e = np.nonzero(np.isfinite(d) & (np.arange(self.ne)[None, :] < nodes.first[:, None]))
        return e, v, q[v, e], d[v, e]


def _link(nodes: Nodes, forest: Forest, a: Block, b: Block, eps: np.ndarray, border: Border | None) -> None:
    """Takes the near pairs of two blocks into the forest and, if asked, as
    border points."""
    ne, top = len(eps), eps[-1]
    some, other = a.near(b, top), b.near(a, top)
    na, nb = nodes.at[a.bid], nodes.at[b.bid]

    def take(some, other):
        for p, q, d in within(a.x[some], b.x[other], np.full(len(some), top)):
            u, v = na[some[p]], nb[other[q]]
            level = np.searchsorted(eps, d)
            fu, fv = nodes.first[u], nodes.first[v]
            both = np.maximum(level, np.maximum(fu, fv))
            ok = (both < ne) & (u != v)
            forest.add(u[ok], v[ok], both[ok])
            if border is not None:
                for x, y, fx, fy in ((u, v, fu, fv), (v, u, fv, fu))[: 1 if a is b else 2]:
                    start = np.maximum(level, fy)
                    ok = start < fx
                    border.add(x[ok], y[ok], d[ok], start[ok])

    both = np.r_[na[some], nb[other]]
    linked = all(len(np.unique(forest.root[e, both[nodes.first[both] <= e]])) < 2 for e in range(ne))
    if not linked:
        take(some, other)
    elif border is not None:  # all core points are linked: what is left are border points
        out_a, out_b = nodes.first[na[some]] > 0, nodes.first[nb[other]] > 0
        take(some[out_a], other)
        if a is not b:
            take(some[~out_a], other[out_b])


def _counts(d: np.ndarray, w: np.ndarray, eps: np.ndarray) -> np.ndarray:
    """Weight within each ε (ascending) of each row."""
    return np.stack([(w * (d <= e)).sum(1) for e in eps], 1)


def dbscan_sweep(points: DataFrame, eps_list: list[float], min_samples: int = 5, block_rows: int = BLOCK_ROWS) -> list[DbscanResult]:
    """Exact DBSCAN of (pid, x) points for several ε at once: the largest
    decides which blocks meet, one count pass and one link pass serve every ε,
    and one label propagation runs over (ε, point) keys. Noise −1; clusters
    numbered 0.. per ε by their smallest core id."""
    import pyarrow as pa

    from .ranking import OrderIndex

    if not eps_list:
        return []
    ensure_checkpoint_dir(points.sparkSession)
    asked = [float(e) for e in eps_list]
    eps = np.array(sorted(set(asked)))
    ne, top = len(eps), float(eps[-1])
    singles = distinct_points(points).transform(written)

    def count_own(b: Block):
        own = np.concatenate([_counts(d, b.w, eps) for _, d in distances(b.x, b.x)])
        return own.ravel(), bool((own[:, 0] < min_samples).any())

    blocks = with_column(ball_blocks(singles, block_rows), "own array<double>, open boolean", count_own).transform(written)

    def count(held, pairs):
        found = {bid: b.row["own"].reshape(-1, ne).copy() for bid, b in held.items()}
        for i, j in pairs:
            if i == j:
                continue
            for a, b in ((held[i], held[j]), (held[j], held[i])):
                if not a.row["open"]:
                    continue
                rows = a.near(b, top)
                rows = rows[found[a.bid][rows, 0] < min_samples]
                more = np.zeros(len(rows) * ne)
                for p, q, d in within(a.x[rows], b.x, np.full(len(rows), top)):
                    more += np.bincount(p * ne + np.searchsorted(eps, d), b.w[q], len(more))
                found[a.bid][rows] += more.reshape(-1, ne).cumsum(1)
        ids, at, more = ([np.empty(0, t)] for t in (np.int64, np.int32, float))
        for bid, b in held.items():
            n = found[bid] - b.row["own"].reshape(-1, ne)
            some = np.flatnonzero(n[:, -1] > 0)
            ids.append(np.full(len(some), bid))
            at.append(some.astype(np.int32))
            more.append(n[some].ravel())
        n = pa.ListArray.from_arrays(pa.array(np.arange(sum(map(len, at)) + 1) * ne, pa.int32()), pa.array(np.concatenate(more)))
        return pa.table({"bid": pa.array(np.concatenate(ids)), "at": pa.array(np.concatenate(at)), "n": n})

    reach = F.lit(top)
    parts = on_pairs(blocks, near_blocks(blocks, reach, F.col("open")).where("i < j"), ["own", "open"], count, "bid long, at int, n array<double>")
    more = parts.groupBy("bid", "at").agg(*[F.sum(F.col("n")[e]).alias(f"n{e}") for e in range(ne)])
    more = more.groupBy("bid").agg(F.collect_list(F.struct("at", F.array(*[f"n{e}" for e in range(ne)]).alias("n"))).alias("more"))  # at most a block's rows

    def flag(b: Block):
        own = b.row["own"].reshape(-1, ne).copy()
        for m in b.row["more"] or []:
            own[m["at"]] += m["n"]
        return ((own >= min_samples).ravel(),)

    flagged = with_column(blocks.join(more.hint("merge"), "bid", "left"), "core array<boolean>", flag).drop("own", "more", "open").transform(written)

    def own_parts(held, pairs):
        nodes = Nodes(held, ne)
        forest = Forest(nodes.alone())
        for i, j in pairs:
            _link(nodes, forest, held[i], held[j], eps, None)
        forest.settle()
        rows = [(bid, np.where(nodes.core[:, nodes.at[bid]], nodes.ids[forest.root[:, nodes.at[bid]]], -1).T.ravel()) for bid in held]
        return pa.table({"bid": pa.array([r[0] for r in rows], pa.int64()), "comp": pa.array([r[1] for r in rows], pa.list_(pa.int64()))})

    near = near_blocks(flagged, reach).transform(written)
    size = group_size(flagged)
    inside = near.where(F.expr(f"i div {size} = j div {size}"))
    comps = on_pairs(flagged, inside, ["core"], own_parts, "bid long, comp array<long>")
    flagged = flagged.join(comps.hint("merge"), "bid").transform(written)

    def link(held, pairs):
        nodes = Nodes(held, ne)
        forest = Forest(nodes.known(held))
        first = forest.root.copy()
        border = Border(len(nodes.ids), ne)
        for i, j in pairs:
            _link(nodes, forest, held[i], held[j], eps, border)
        forest.settle()
        e, v = np.nonzero((first == np.arange(len(nodes.ids))) & (forest.root != first) & nodes.core)
        be, bv, bq, bd = border.told(nodes)
        cols = (np.r_[e, be].astype(np.int32), nodes.ids[np.r_[v, bv]], nodes.ids[np.r_[forest.root[e, v], bq]], np.r_[np.zeros(len(e)), np.ones(len(be))].astype(np.int32), np.r_[np.zeros(len(e)), bd])
        return pa.table(dict(zip(("e", "a", "b", "kind", "dist"), map(pa.array, cols))))

    links = on_pairs(flagged, near, ["core", "comp"], link, "e int, a long, b long, kind int, dist double").transform(written)
    edges = links.where(F.col("kind") == 0).select("e", "a", "b")

    def exploded(batches):
        for t in batches:
            for k in range(t.num_rows):
                b = {n: _value(t.column(t.schema.get_field_index(n))[k], n) for n in ("ids", "comp")}
                own = b["comp"].reshape(-1, ne)
                at, e = np.nonzero(own >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(e, pa.int32()), pa.array(b["ids"][at]), pa.array(own[at, e])], names=["e", "pid", "own"])

    cores = flagged.select("ids", "comp").mapInArrow(exploded, "e int, pid long, own long").transform(written)
    joined = _components(edges, cores.where("pid = own").select("e", "pid"), ["e", "pid"])
    comp = cores.join(joined.select("e", F.col("pid").alias("own"), "comp"), ["e", "own"]).select("e", "pid", "comp")
    reps = comp.select("e", "comp").distinct().withColumn("g", F.col("e").cast("string"))
    numbered = OrderIndex(reps, ["comp"], group_col="g").with_position("cluster").select(
        "e", "comp", (F.col("cluster") - 1).alias("cluster")
    )
    core_lab = comp.join(numbered, ["e", "comp"]).select("e", "pid", "cluster")
    border = (
        links.where(F.col("kind") == 1)
        .groupBy("e", "a")
        .agg(F.min_by("b", F.struct("dist", "b")).alias("core_pid"))
        .join(core_lab.select("e", F.col("pid").alias("core_pid"), "cluster"), ["e", "core_pid"])
        .select("e", F.col("a").alias("pid"), "cluster")
    )
    lab = core_lab.unionByName(border).select("e", F.col("pid").alias("id"), "cluster")
    grid = singles.select("id").withColumn("e", F.explode(F.sequence(F.lit(0), F.lit(ne - 1))))
    told = grid.join(lab, ["e", "id"], "left").select("e", "id", F.coalesce("cluster", F.lit(-1)).cast("long").alias("dbscan_label")).transform(written)
    labels = of_copies(points, singles, told).select("e", "pid", "dbscan_label").transform(written)
    stats = {
        r["e"]: r
        for r in labels.groupBy("e").agg(
            F.count_distinct(F.when(F.col("dbscan_label") >= 0, F.col("dbscan_label"))).alias("k"),
            F.count_if(F.col("dbscan_label") < 0).alias("noise"),
        ).collect()
    }  # ne rows
    number = {e: k for k, e in enumerate(eps.tolist())}
    return [
        DbscanResult(
            e, labels.where(F.col("e") == number[e]).drop("e"), int(stats[number[e]]["k"]), int(stats[number[e]]["noise"]),
            singles.join(told.where(F.col("e") == number[e]).drop("e"), "id"),
        )
        for e in asked
    ]


def dbscan(points: DataFrame, eps: float, min_samples: int = 5, block_rows: int = BLOCK_ROWS) -> DbscanResult:
    """Exact DBSCAN on (pid, x) for one ε. Noise −1."""
    return dbscan_sweep(points, [eps], min_samples, block_rows)[0]
