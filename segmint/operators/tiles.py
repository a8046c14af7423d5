"""Work on all pairs of two point sets, block by block.

The rows of each side are dealt into blocks by a hash; every block of one
side meets every block of the other with the same key in one task, which
reduces the pairs there. A row is copied once for each block of the other
side, pairs never leave a task, and no key makes a block larger.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Rows of a block, on average, of a small side.
ROWS = 4096
#: Blocks of a side: larger blocks take larger sides, up to ``GROWTH`` times
#: ``ROWS``, so that the copies of a row do not grow with the table.
SIDES, GROWTH = 16, 8
#: Cells of a distance array held at once.
CELLS = 1 << 22
#: Cells of a single-precision product held at once, pairs measured at once.
TILE, PAIRS = 1 << 18, 1 << 16


def fresh(df: DataFrame) -> DataFrame:
    """New attribute ids, so a frame can meet itself in a join."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def blocks_of(n: Column, rows: int) -> Column:
    """The number of blocks of a side of ``n`` rows."""
    return F.ceil(n / F.greatest(F.lit(rows), F.least(F.lit(GROWTH * rows), n / SIDES))).cast("int")


def block_counts(df: DataFrame, key: list[str], name: str, rows: int) -> DataFrame:
    return df.groupBy(*key).agg(blocks_of(F.count(F.lit(1)), rows).alias(name))


def meet(left: DataFrame, right: DataFrame, key: list[str], left_id: Column, right_id: Column, fn, schema: str, rows: int = ROWS) -> DataFrame:
    """``fn(key, left table, right table)`` (Arrow) of every pair of blocks
    with an equal key; keys that one side lacks give nothing. The ids must be
    the same whenever a row is computed: they deal it to its block."""
    left, right = fresh(left), fresh(right)
    sizes = block_counts(left, key, "_nl", rows).join(block_counts(right, key, "_nr", rows), key)
    sizes_l, sizes_r = fresh(sizes), fresh(sizes)
    to = lambda ident, n: F.pmod(F.xxhash64(ident), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    ll = left.withColumn("_i", left_id).join(sizes_l, key).withColumn("_l", to(F.col("_i"), "_nl")).withColumn("_r", every("_nr")).drop("_i", "_nl", "_nr")
    rr = right.withColumn("_i", right_id).join(sizes_r, key).withColumn("_r", to(F.col("_i"), "_nr")).withColumn("_l", every("_nl")).drop("_i", "_nl", "_nr")
    return ll.groupBy(*key, "_l", "_r").cogroup(rr.groupBy(*key, "_l", "_r")).applyInArrow(fn, schema)


def meet_all(left: DataFrame, right: DataFrame, n_left: int, n_right: int, left_id: Column, right_id: Column, fn, schema: str, rows: int = ROWS) -> DataFrame:
    """``meet`` without a key, for sides of known size: two shuffles and no
    join."""
    a, b = (max(1, -(-n // max(rows, min(GROWTH * rows, n // SIDES)))) for n in (n_left, n_right))
    to = lambda ident, n: F.pmod(F.xxhash64(ident), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    ll = fresh(left).withColumn("_i", left_id).withColumn("_l", to(F.col("_i"), a)).withColumn("_r", every(b)).drop("_i")
    rr = fresh(right).withColumn("_i", right_id).withColumn("_r", to(F.col("_i"), b)).withColumn("_l", every(a)).drop("_i")
    return ll.groupBy("_l", "_r").cogroup(rr.groupBy("_l", "_r")).applyInArrow(fn, schema)


def distinct_points(points: DataFrame) -> DataFrame:
    """(id, n, x): equal points as one, named by the smallest pid. Minus zero
    counts as zero."""
    x = F.transform("x", lambda v: v + F.lit(0.0))
    return points.select("pid", x.alias("x")).groupBy("x").agg(F.min("pid").alias("id"), F.count(F.lit(1)).cast("double").alias("n")).select("id", "n", "x")


def unique_ids(points: DataFrame) -> bool:
    """Whether every point has a pid of its own."""
    n = points.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("pid").alias("pids")).first()
    return n["rows"] == n["pids"]


def key_of(singles: DataFrame):
    """A function from a column of points to a narrow key that no two of the
    distinct points share, so that points meet theirs without a comparison or
    a shuffle of vectors. The point itself where no such key is found."""
    for seed in range(4):
        # the seed goes first: the hash of what comes before seeds the next
        key = lambda x, seed=seed: F.struct(F.xxhash64(F.lit(2 * seed), x), F.xxhash64(F.lit(2 * seed + 1), x))
        if singles.select(key(F.col("x")).alias("_k")).groupBy("_k").count().where("count > 1").isEmpty():
            return key
    return lambda x: x


def of_singles(points: DataFrame, singles: DataFrame, found: DataFrame) -> DataFrame:
    """The (pid, x, ...) points with the columns found for the distinct points
    by ``id``, which stays."""
    key = key_of(singles)
    x = F.transform("x", lambda v: v + F.lit(0.0))
    # written, so that Spark knows its size: a small one is sent to the points
    named = singles.where(F.col("x").isNotNull()).select("id", key(F.col("x")).alias("_k")).join(found, "id").transform(written)
    return points.where(F.col("x").isNotNull()).withColumn("_k", key(x)).join(named, "_k").drop("_k")


def matrix(table, name: str = "x") -> np.ndarray:
    """The rows of an array<double> Arrow column as a 2-d array."""
    col = table.column(name).combine_chunks()
    flat = np.asarray(col.flatten(), dtype=float)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def column(table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def distances(a: np.ndarray, b: np.ndarray, squared: bool = False):
    """(first row, distances of some rows of ``a`` to all of ``b``), a bounded
    piece at a time. Both are centred on the rows of ``b``, and what cancels
    nearly to nothing is taken again from the differences."""
    if not len(a) or not len(b):
        return
    mid = b.mean(0)
    ac, bc = a - mid, b - mid
    an, bn = np.einsum("ij,ij->i", ac, ac), np.einsum("ij,ij->i", bc, bc)
    step = max(1, CELLS // len(b))
    for lo in range(0, len(a), step):
        d = an[lo : lo + step, None] + bn[None, :]
        near = 1e-6 * d
        d -= 2.0 * (ac[lo : lo + step] @ bc.T)
        i, j = np.nonzero(d <= near)
        # pairs that may cancel are few but for copies; those go in pieces too
        for k in range(0, len(i), CELLS // max(1, a.shape[1])):
            p, q = i[k : k + CELLS // max(1, a.shape[1])], j[k : k + CELLS // max(1, a.shape[1])]
            diff = a[lo + p] - b[q]
            d[p, q] = np.einsum("ij,ij->i", diff, diff)
        yield lo, (d if squared else np.sqrt(d))


def halves(a: np.ndarray, b: np.ndarray):
    """(left, right, room, squares of a): the product of ``left`` and
    ``right`` is the squared distances, in single precision where the numbers
    allow, less ``room`` times the squares of both rows: never more than the
    true ones."""
    mid = b.mean(0)
    ac, bc = a - mid, b - mid
    an, bn = np.einsum("ij,ij->i", ac, ac), np.einsum("ij,ij->i", bc, bc)
    most = max(an.max(), bn.max())
    kind = np.float32 if 1e-20 < most < 1e20 else np.float64
    room = 8.0 * (a.shape[1] + 8) * float(np.finfo(kind).eps)
    left = np.column_stack([-2.0 * ac, np.ones(len(a)), an * (1 - room)]).astype(kind)
    right = np.vstack([bc.T, bn * (1 - room), np.ones(len(b))]).astype(kind)
    return left, right, room, 8 * most


def measured(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of the rows i of ``a`` and j of ``b``, from their
    differences."""
    out = np.empty(len(i))
    for k in range(0, len(i), PAIRS):
        diff = a[i[k : k + PAIRS]] - b[j[k : k + PAIRS]]
        out[k : k + PAIRS] = np.einsum("ij,ij->i", diff, diff)
    return out


def within(a: np.ndarray, b: np.ndarray, limit: np.ndarray):
    """(i, j, d), some at a time: the rows i of ``a`` and j of ``b`` whose
    distance d is at most ``limit[i]``. A bound in single precision rules out
    most pairs; the others are measured."""
    if not len(a) or not len(b):
        return
    left, right, room, most = halves(a, b)
    left[:, -1] -= (np.minimum(limit * limit, most) * (1 + room)).astype(left.dtype)
    step = max(1, TILE // len(b))
    for lo in range(0, len(a), step):
        s = left[lo : lo + step] @ right
        at = np.flatnonzero(s <= 0)
        if 8 * len(at) > s.size:  # most pairs are near: all are measured at once
            for k, d in distances(a[lo : lo + step], b):
                i, j = np.nonzero(d <= limit[lo + k : lo + k + len(d), None])
                yield lo + k + i, j, d[i, j]
        elif len(at):
            i, j = lo + at // len(b), at % len(b)
            d = np.sqrt(measured(a, b, i, j))
            ok = d <= limit[i]
            yield i[ok], j[ok], d[ok]
