"""Connected components of a distributed edge list by alternating large-star
and small-star steps; every step works on map-side combined minima, so a
vertex with very many neighbours is no hot task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _signature(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.pmod(h, F.lit(1 << 31))), F.sum(F.pmod(F.shiftright(h, 31), F.lit(1 << 31)))).first())


def _minima(pairs: DataFrame) -> DataFrame:
    """Each (u, v) with the smallest of u and all its v."""
    least = pairs.groupBy(F.col("u").alias("k")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return pairs.join(least, F.col("u") == F.col("k")).select("u", "v", "m")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, component): for every vertex with an edge to another one, the
    smallest vertex of its component, itself included. It runs until nothing
    changes; each round is written to the shared folder."""
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    e = materialize(e, "edges")
    sign = _signature(e)
    while True:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _minima(both).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        small = _minima(large.select(F.col("a").alias("u"), F.col("b").alias("v")))
        small = small.select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("e"))
        e = materialize(small.select("e.a", "e.b").where("a <> b").distinct(), "edges")
        new = _signature(e)
        if new == sign:
            break
        sign = new
    return e.select(F.col("a").alias("vertex"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct())
