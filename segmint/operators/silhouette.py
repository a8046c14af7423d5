"""Cluster quality for any number of clusters, and the silhouette over plain
Euclidean distances.

Statistics of the clusters (size, centre, mean squared norm) stay a
DataFrame; clusters meet each other, and points meet clusters, in blocks
(``tiles.meet``). Nothing of the order of the number of clusters reaches the
driver or is broadcast by hand.

The silhouette needs the mean distance from a point to the points of its own
cluster and of the nearest other one. By Jensen's inequality the mean lies
between the distance to the centre and the root of the mean squared distance,
and both follow from the statistics. Only clusters whose lower bound is not
above the least upper bound can be the nearest; all others are left out, and
the remaining sums are exact. Blocks of whole clusters meet blocks of points,
and a task tells one row a point, so nothing is written for a pair of a point
and a cluster. The work is that of the pairs within clusters and between near
ones: with the square of a cluster's size, or of the points where the bounds
of small clusters rule nothing out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tiles import ROWS, block_counts, blocks_of, column, distances, fresh, matrix, meet

#: Slack of the bounds for rounding errors.
SLACK = 1e-9


#: Numbers of the statistics that a task may hold beside its points.
HELD = 1 << 20

KEY = ["run", "label"]


def statistics(points: DataFrame) -> DataFrame:
    """(run, label, n, x, ms): size, centre and mean squared distance to the
    centre of every cluster of (run, pid, x, label) points, where a run is one
    labelling of them; a row with a ``w`` column counts as so many points.
    Sums are combined before the shuffle."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    if "w" in points.columns:
        s = Summarizer.metrics("mean", "variance").summary(array_to_vector("x"), F.col("w").cast("double"))
        stats = points.groupBy(*KEY).agg(F.sum("w").cast("long").alias("n"), F.sum(F.col("w") * F.col("w")).cast("double").alias("n2"), s.alias("s"))
        spread = F.aggregate(vector_to_array("s.variance"), F.lit(0.0), lambda a, v: a + v)
        # the summary's variance divides by n - n2 / n
        return stats.select(*KEY, "n", vector_to_array("s.mean").alias("x"), (spread * (F.col("n") - F.col("n2") / F.col("n")) / F.col("n")).alias("ms"))
    s = Summarizer.metrics("mean", "variance").summary(array_to_vector("x"))
    spread = F.aggregate(vector_to_array("s.variance"), F.lit(0.0), lambda a, v: a + v)
    stats = points.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), s.alias("s"))
    # the summary's variance divides by n - 1
    ms = F.when(F.col("n") > 1, spread * (F.col("n") - 1) / F.col("n")).otherwise(F.lit(0.0))
    return stats.select(*KEY, "n", vector_to_array("s.mean").alias("x"), ms.alias("ms"))


def _empty(schema):
    import pyarrow as pa

    return pa.schema(schema).empty_table()


def _point_type(points: DataFrame) -> str:
    return points.schema["pid"].dataType.simpleString()


def nearest_other(points: DataFrame, stats: DataFrame, rows: int = ROWS) -> DataFrame:
    """(run, pid, b): the least mean squared distance from each point to the
    points of another cluster, which follows from the statistics."""
    import pyarrow as pa

    def fn(key, p, c):
        if not p.num_rows or not c.num_rows:
            return _empty([("run", pa.int32()), ("pid", p.schema.field("pid").type), ("b", pa.float64())])
        own, labels, ms = column(p, "label"), column(c, "label"), column(c, "ms")
        least = np.full(p.num_rows, np.inf)
        for lo, d in distances(matrix(p), matrix(c), squared=True):
            part = slice(lo, lo + len(d))
            d += ms[None, :]
            d[own[part, None] == labels[None, :]] = np.inf
            least[part] = d.min(1)
        return pa.table({"run": p.column("run"), "pid": p.column("pid"), "b": pa.array(least)})

    parts = meet(points, stats.select("run", "label", "x", "ms"), ["run"], F.col("pid"), F.col("label"), fn, f"run int, pid {_point_type(points)}, b double", rows)
    return parts.groupBy("run", "pid").agg(F.min("b").alias("b"))


def dealt(points: DataFrame, stats: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """(points and the centres of their clusters with the block they lie in,
    blocks of each run). A cluster of up to ``rows`` points lies in one block
    as a whole, larger ones have blocks of their own."""
    size = stats.select(*KEY, F.col("n").alias("_n"))
    one = F.col("_n") <= rows
    runs = size.groupBy("run").agg(F.greatest(F.lit(1), blocks_of(F.sum(F.when(one, F.col("_n")).otherwise(0)), rows)).alias("_small"))
    parts = F.when(one, F.lit(0)).otherwise(blocks_of(F.col("_n"), rows))
    before = Window.partitionBy("run").orderBy("label").rowsBetween(Window.unboundedPreceding, -1)
    large = size.where(~one).withColumn("_parts", parts)  # no more than all points by ``rows``
    large = large.withColumn("_first", F.coalesce(F.sum("_parts").over(before), F.lit(0))).join(runs, "run")
    places = size.where(one).join(runs, "run").select(*KEY, "_n", F.pmod(F.xxhash64("label"), "_small").alias("_first"), F.lit(1).alias("_parts"))
    places = places.unionByName(large.select(*KEY, "_n", (F.col("_first") + F.col("_small")).alias("_first"), "_parts"))
    total = large.groupBy("run").agg(F.sum("_parts").alias("_large"))
    blocks = runs.join(total, "run", "left").select("run", (F.col("_small") + F.coalesce("_large", F.lit(0))).cast("int").alias("_nr"))
    at = (F.col("_first") + F.pmod(F.xxhash64("pid"), "_parts")).cast("int")
    rest = points.select(*KEY, "pid", "x").join(places, KEY).select(*KEY, "x", F.col("_n").alias("n"), (F.col("_parts") > 1).alias("split"), F.lit(False).alias("centre"), at.alias("_r"))
    each = F.explode(F.sequence(F.col("_first").cast("int"), (F.col("_first") + F.col("_parts") - 1).cast("int")))
    centres = stats.select(*KEY, "x").join(places, KEY).select(*KEY, "x", F.col("_n").alias("n"), (F.col("_parts") > 1).alias("split"), F.lit(True).alias("centre"), each.alias("_r"))
    return rest.unionByName(centres), blocks


def mean_distances(points: DataFrame, stats: DataFrame, rows: int = ROWS) -> DataFrame:
    """(run, pid, label, total, b): the sum of the distances from each point
    to those of its own cluster and the least mean distance to another one."""
    import pyarrow as pa

    kind = points.schema["pid"].dataType

    def fn(key, p, q):
        cols = {"run": p.column("run"), "pid": p.column("pid"), "label": p.column("label")}
        names = {"target": pa.int64(), "total": pa.float64(), "b": pa.float64(), "n": pa.int64()}
        empty = pa.schema([*((c, v.type) for c, v in cols.items()), *names.items()]).empty_table()
        if not p.num_rows or not q.num_rows:
            return empty
        own, least, xp = column(p, "label"), column(p, "least"), matrix(p)
        label, centre, xq = column(q, "label"), column(q, "centre").astype(bool), matrix(q)
        order = np.flatnonzero(~centre)[np.argsort(label[~centre], kind="stable")]
        labels, starts, counts = np.unique(label[order], return_index=True, return_counts=True)
        if not len(labels):
            return empty
        held = np.flatnonzero(centre)[np.argsort(label[centre], kind="stable")]
        held = held[np.searchsorted(label[held], labels)]
        n, split = column(q, "n")[held], column(q, "split").astype(bool)[held]
        xq, centres = xq[order], xq[held]
        total, b, partial = np.zeros(len(own)), np.full(len(own), np.inf), []
        need = np.empty((len(own), len(labels)), bool)
        for lo, d in distances(xp, centres):
            part = slice(lo, lo + len(d))
            need[part] = (d * (1 - SLACK) <= least[part, None]) | (own[part, None] == labels[None, :])

        def take(r, ks, sums):
            """The sums from the points r to the clusters ks."""
            mine = own[r, None] == labels[None, ks]
            i, j = np.nonzero(mine)
            total[r[i]] = sums[i, j]
            other = need[np.ix_(r, ks)] & ~mine
            whole = np.where(other & ~split[None, ks], sums / n[None, ks], np.inf)
            b[r] = np.minimum(b[r], whole.min(1))
            i, j = np.nonzero(other & split[None, ks])
            if len(i):
                partial.append((r[i], labels[ks[j]], sums[i, j], n[ks[j]]))

        # large clusters one by one, for the points that need them; the small ones together
        big = counts >= 256
        for k in np.flatnonzero(big):
            r = np.flatnonzero(need[:, k])
            for lo, d in distances(xp[r], xq[starts[k] : starts[k] + counts[k]]):
                take(r[lo : lo + len(d)], np.array([k]), d.sum(1)[:, None])
        small = np.flatnonzero(~big)
        if len(small):
            r = np.flatnonzero(need[:, small].any(1))
            some = np.repeat(~big, counts)
            cuts = np.cumsum(counts[small]) - counts[small]
            for lo, d in distances(xp[r], xq[some]):
                take(r[lo : lo + len(d)], small, np.add.reduceat(d, cuts, axis=1))
        at = np.flatnonzero((total > 0) | np.isfinite(b))
        t = p.take(pa.array(at))
        none = pa.nulls(len(at))
        out = [pa.table({**{c: t.column(c) for c in cols}, "target": none.cast(pa.int64()), "total": pa.array(total[at]), "b": pa.array(b[at]), "n": none.cast(pa.int64())})]
        for i, target, sums, size in partial:
            t = p.take(pa.array(i))
            out.append(pa.table({**{c: t.column(c) for c in cols}, "target": pa.array(target, pa.int64()), "total": pa.array(sums), "b": pa.nulls(len(i), pa.float64()), "n": pa.array(size, pa.int64())}))
        return pa.concat_tables(out)

    bound = nearest_other(points, stats, rows).select("run", "pid", (F.sqrt("b") * (1 + SLACK)).alias("least"))
    left = points.select("run", "pid", "x", "label").join(bound.hint("merge"), ["run", "pid"]).dropDuplicates(["run", "pid", "label"])
    right, blocks = dealt(points, stats, rows)
    own_blocks = fresh(block_counts(fresh(points), ["run"], "_nl", rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    ll = left.join(own_blocks.join(fresh(blocks), "run"), "run").withColumn("_l", F.pmod(F.xxhash64("pid"), "_nl").cast("int")).withColumn("_r", every("_nr")).drop("_nl", "_nr")
    rr = right.join(fresh(own_blocks), "run").withColumn("_l", every("_nl")).drop("_nl")
    schema = f"run int, pid {kind.simpleString()}, label long, target long, total double, b double, n long"
    found = fresh(ll).groupBy("run", "_l", "_r").cogroup(fresh(rr).groupBy("run", "_l", "_r")).applyInArrow(fn, schema)
    each = found.groupBy("run", "pid", "label", "target").agg(F.sum("total").alias("total"), F.min("b").alias("b"), F.max("n").alias("n"))
    mine = F.col("target").isNull()
    return each.groupBy("run", "pid", "label").agg(
        F.coalesce(F.sum(F.when(mine, F.col("total"))), F.lit(0.0)).alias("total"),
        F.min(F.when(mine, F.col("b")).otherwise(F.col("total") / F.col("n"))).alias("b"),
    )


def silhouette_samples(points: DataFrame, rows: int = ROWS) -> DataFrame:
    """(run, pid, label, silhouette) of (run, pid, x, label) rows over plain
    Euclidean distances, exactly: (b - a) / max(a, b) with a the mean distance
    to the other points of the own cluster and b the least mean distance to
    another cluster; 0 for the only point of a cluster and where a = b = 0. A
    run with one cluster has none, so no row. ``pid`` must be unique in a run;
    the input should be a written table, it is read several times."""
    stats = statistics(points)
    told = mean_distances(points, stats, rows).join(stats.select(*KEY, "n"), KEY)
    a = F.when(F.col("n") > 1, F.col("total") / (F.col("n") - 1))
    told = told.where(F.col("b") < float("inf"))
    return told.select("run", "pid", "label", _silhouette(F.col("n"), a, F.col("b")).alias("silhouette"))


def _silhouette(n: Column, a: Column, b: Column) -> Column:
    most = F.greatest(a, b)
    return F.when((n > 1) & (most > 0), (b - a) / most).otherwise(F.lit(0.0))


def with_spread(points: DataFrame, stats: DataFrame) -> DataFrame:
    """(run, pid, label, n, ms, e2): each point with its cluster's size and
    spread and its squared distance to the centre, and its ``w`` if there is one."""
    both = points.join(stats.select(*KEY, "n", "ms", F.col("x").alias("_c")), KEY)
    e2 = F.aggregate(F.zip_with("x", "_c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    return both.select("run", "pid", "label", "n", "ms", e2.alias("e2"), *_weight(points))


def _weight(points: DataFrame) -> list[str]:
    return ["w"] if "w" in points.columns else []


def beside_centres(points: DataFrame, stats: DataFrame) -> DataFrame:
    """``with_spread`` and the b of ``nearest_other`` for statistics of at
    most ``HELD`` numbers, which go to the tasks: points are not shuffled."""
    import pyarrow as pa

    t = stats.select("run", "label", "n", "ms", "x").toArrow()  # at most HELD numbers
    held: dict = {}
    if t.num_rows:
        runs, x = column(t, "run"), matrix(t)
        for r in np.unique(runs):
            at = np.flatnonzero(runs == r)
            at = at[np.argsort(column(t, "label")[at])]
            held[int(r)] = tuple(column(t, c)[at] for c in ("label", "n", "ms")) + (x[at],)
    shared = points.sparkSession.sparkContext.broadcast(held)
    weight = _weight(points)

    def fn(batches):
        for batch in batches:
            p = pa.Table.from_batches([batch])
            if not p.num_rows:
                continue
            run, label, x = column(p, "run"), column(p, "label"), matrix(p)
            n, ms, e2, b = np.zeros(len(x), np.int64), np.zeros(len(x)), np.zeros(len(x)), np.full(len(x), np.inf)
            for r in np.unique(run):
                labels, sizes, spread, centres = shared.value[int(r)]
                at = np.flatnonzero(run == r)
                own = np.searchsorted(labels, label[at])
                n[at], ms[at], e2[at] = sizes[own], spread[own], ((x[at] - centres[own]) ** 2).sum(1)
                for lo, d in distances(x[at], centres, squared=True):
                    d += spread[None, :]
                    d[np.arange(len(d)), own[lo : lo + len(d)]] = np.inf
                    b[at[lo : lo + len(d)]] = d.min(1)
            out = {"run": p.column("run"), "pid": p.column("pid"), "label": p.column("label"), "n": pa.array(n), "ms": pa.array(ms), "e2": pa.array(e2), "b": pa.array(b)}
            out |= {c: p.column(c) for c in weight}
            yield from pa.table(out).to_batches()

    schema = f"run int, pid {_point_type(points)}, label long, n long, ms double, e2 double, b double"
    return points.select("run", "pid", "x", "label", *weight).mapInArrow(fn, schema + "".join(f", {c} {points.schema[c].dataType.simpleString()}" for c in weight))


def squared_summary(points: DataFrame, stats: DataFrame, rows: int = ROWS) -> DataFrame:
    """(run, label, s, total, told): the mean distance to the centre of each
    cluster and the sum and number of the silhouettes of its points over
    squared distances, whose means need the clusters' statistics alone."""
    size = stats.agg(F.sum(F.size("x") + 4)).first()[0] or 0
    if size <= HELD:
        told = beside_centres(points, stats)
    else:
        told = with_spread(points, stats).join(nearest_other(points, stats, rows), ["run", "pid"], "left")
    a = F.when(F.col("n") > 1, (F.col("e2") + F.col("ms")) * F.col("n") / (F.col("n") - 1)).otherwise(F.lit(0.0))
    has = F.col("pid").isNotNull() & (F.col("b") < float("inf"))
    one = F.when(has, _silhouette(F.col("n"), a, F.col("b")))
    if _weight(points):
        w = F.col("w")
        return told.groupBy(*KEY).agg((F.sum(w * F.sqrt("e2")) / F.sum(w)).alias("s"), F.sum(w * one).alias("total"), F.sum(F.when(one.isNotNull(), w)).alias("told"))
    return told.groupBy(*KEY).agg(F.avg(F.sqrt("e2")).alias("s"), F.sum(one).alias("total"), F.count(one).alias("told"))


def davies_bouldin(points: DataFrame, stats: DataFrame, rows: int = ROWS, spread: DataFrame | None = None) -> DataFrame:
    """(run, davies_bouldin) of every run of two clusters or more: the mean
    over the clusters of the largest (s_i + s_j) / |c_i - c_j|, s the mean
    distance to the own centre (``spread``, if known); centres that coincide
    count as infinitely far apart."""
    import pyarrow as pa

    if spread is None:
        spread = with_spread(points, stats).groupBy(*KEY).agg(F.avg(F.sqrt("e2")).alias("s"))
    centres = stats.join(spread, KEY).select("run", "label", "x", "s")

    def fn(key, p, q):
        if not p.num_rows or not q.num_rows:
            return _empty([("run", pa.int32()), ("label", pa.int64()), ("worst", pa.float64())])
        a, b, sa, sb = column(p, "label"), column(q, "label"), column(p, "s"), column(q, "s")
        worst = np.full(len(a), -np.inf)
        for lo, d in distances(matrix(p), matrix(q)):
            part = slice(lo, lo + len(d))
            ratio = np.divide(sa[part, None] + sb[None, :], d, out=np.zeros_like(d), where=d > 0)
            ratio[a[part, None] == b[None, :]] = -np.inf
            worst[part] = ratio.max(1)
        return pa.table({"run": p.column("run"), "label": pa.array(a), "worst": pa.array(worst)})

    parts = meet(centres, centres, ["run"], F.col("label"), F.col("label"), fn, "run int, label long, worst double", rows)
    each = parts.groupBy(*KEY).agg(F.max("worst").alias("worst")).where(F.col("worst") >= 0)
    return each.groupBy("run").agg(F.avg("worst").alias("davies_bouldin"))


def dispersion(stats: DataFrame) -> DataFrame:
    """(run, n_clusters, n_points, inertia, calinski_harabasz): the dispersion
    between centres over that within clusters, 1 where nothing is within."""
    # sum over the dimensions of (sum n v^2 - (sum n v)^2 / N)
    per = stats.select("run", "n", F.posexplode("x").alias("i", "v")).groupBy("run", "i").agg(
        F.sum(F.col("n") * F.col("v") * F.col("v")).alias("vv"), F.sum(F.col("n") * F.col("v")).alias("v"), F.sum("n").alias("n")
    )
    between = per.groupBy("run").agg(F.sum(F.col("vv") - F.col("v") * F.col("v") / F.col("n")).alias("between"))
    whole = stats.groupBy("run").agg(F.sum("n").alias("n_points"), F.count(F.lit(1)).alias("n_clusters"), F.sum(F.col("n") * F.col("ms")).alias("inertia"))
    free = F.col("n_points") - F.col("n_clusters")
    ratio = F.when((F.col("inertia") > 0) & (free > 0), F.col("between") / (F.col("n_clusters") - 1) / (F.col("inertia") / free)).otherwise(F.lit(1.0))
    return whole.join(between, "run").withColumn("calinski_harabasz", F.when(F.col("n_clusters") >= 2, ratio)).drop("between")


def quality(points: DataFrame, euclidean: bool = False, rows: int = ROWS) -> DataFrame:
    """One row a run: run, n_clusters, n_points, inertia, calinski_harabasz,
    davies_bouldin, silhouette (the mean over the points; squared distances
    unless ``euclidean``). Runs of one cluster have only the first three.
    Points are (run int, pid, x array<double>, label long); all runs share
    each pass. For squared distances a column ``w`` tells copies of a row. The input should be a written table."""
    from ..session import ensure_checkpoint_dir, written

    ensure_checkpoint_dir(points.sparkSession)
    if euclidean and _weight(points):
        raise ValueError("plain Euclidean silhouettes take a row for each point")
    stats = statistics(points).transform(written)
    if euclidean:
        spread = None
        mean = silhouette_samples(points, rows).groupBy("run").agg(F.avg("silhouette").alias("silhouette"))
    else:
        told = squared_summary(points, stats, rows).transform(written)
        spread = told.select(*KEY, "s")
        mean = told.groupBy("run").agg((F.sum("total") / F.sum("told")).alias("silhouette"))
    return dispersion(stats).join(davies_bouldin(points, stats, rows, spread), "run", "left").join(mean, "run", "left")
