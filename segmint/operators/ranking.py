"""Exact, distributed ranks and order statistics.

Spark's ``row_number()`` over a global order (no PARTITION BY) moves every
row into one task. Here the rows are range-partitioned on the full sort key
(group, value, unique tie-break), sorted inside each partition, and numbered
with ``monotonically_increasing_id`` (partition index in the high bits, local
position in the low 33 bits). The sorted copy is reliably checkpointed so
that the per-partition counts and the rows come from one materialisation.
Per-(partition, group) counts are a tiny frame (≤ partitions × groups rows),
from which each row's exact position inside its group follows.

Because the tie-break is part of the range key, a value held by a third of
all rows is still spread over many range partitions.

Built on this:

* ``OrderIndex.rows_at`` – rows at given positions (bounded output): exact
  quantiles / medians and quantile-bin boundaries.
* ``global_row_number``  – a rank column for every row (``rank_first``).
* ``quantile_bin_columns`` – pandas ``qcut(rank(method="first"), q)`` bins as a
  pure projection comparing each row with q−1 boundary keys (no join back).
"""

from __future__ import annotations

from collections import defaultdict
from typing import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

_LOCAL_BITS = 33
_LOCAL_MASK = (1 << _LOCAL_BITS) - 1
_NO_GROUP = "__all__"


class OrderIndex:
    """A sorted, checkpointed copy of ``df`` with in-group positions."""

    def __init__(
        self,
        df: DataFrame,
        order_cols: list[str],
        group_col: str | None = None,
        partitions: int | None = None,
        value_col: str | None = None,
    ):
        spark = df.sparkSession
        ensure_checkpoint_dir(spark)
        self.group_col = group_col
        keys = ([group_col] if group_col else []) + list(order_cols)
        ordering = [F.col(k).asc_nulls_last() for k in keys]
        # Without an explicit count the range exchange uses
        # spark.sql.shuffle.partitions and AQE may coalesce adjacent ranges
        # (order is kept), so the partition count follows the data volume.
        ranged = df.repartitionByRange(partitions, *ordering) if partitions else df.repartitionByRange(*ordering)
        sorted_df = (
            ranged
            .sortWithinPartitions(*ordering)
            .withColumn("_mid", F.monotonically_increasing_id())
        )
        self.rows = (
            sorted_df.checkpoint(eager=True)
            .withColumn("_pid", F.shiftrightunsigned(F.col("_mid"), _LOCAL_BITS))
            .withColumn("_loc", F.col("_mid").bitwiseAND(F.lit(_LOCAL_MASK)))
            .drop("_mid")
        )
        gexpr = F.col(group_col) if group_col else F.lit(_NO_GROUP)
        seg_rows = (
            self.rows.groupBy("_pid", gexpr.alias("_g"))
            .agg(
                F.count(F.lit(1)).alias("_cnt"),
                F.min("_loc").alias("_first"),
                F.count(F.col(value_col) if value_col else F.lit(1)).alias("_nn"),
            )
            .collect()
        )  # bounded: partitions x groups rows
        by_group: dict = defaultdict(list)
        self.non_null: dict = defaultdict(int)
        for r in seg_rows:
            by_group[r["_g"]].append((r["_pid"], r["_cnt"], r["_first"]))
            self.non_null[r["_g"]] += r["_nn"]
        self.segments: dict = {}
        self.n: dict = {}
        for g, segs in by_group.items():
            segs.sort()
            before = 0
            out = []
            for pid, cnt, first in segs:
                out.append((pid, before, cnt, first))
                before += cnt
            self.segments[g] = out
            self.n[g] = before

    def count(self, group=_NO_GROUP) -> int:
        return self.n.get(group, 0)

    def _locate(self, group, pos: int):
        for pid, before, cnt, first in self.segments.get(group, []):
            if before < pos <= before + cnt:
                return pid, first + (pos - before - 1)
        raise IndexError(f"position {pos} outside group {group!r}")

    def rows_at(self, wanted: dict) -> dict:
        """``wanted``: {group: [1-based positions]} -> {(group, pos): Row}."""
        targets = {}
        for g, positions in wanted.items():
            for pos in set(positions):
                targets[self._locate(g, pos)] = (g, pos)
        if not targets:
            return {}
        cond = None
        for pid, loc in targets:
            term = (F.col("_pid") == F.lit(pid)) & (F.col("_loc") == F.lit(loc))
            cond = term if cond is None else (cond | term)
        found = self.rows.where(cond).collect()  # bounded by len(targets)
        return {targets[(r["_pid"], r["_loc"])]: r for r in found}

    def with_position(self, out: str = "rn") -> DataFrame:
        """Every row with its exact 1-based position inside its group."""
        spark = self.rows.sparkSession
        seg = [(int(pid), str(g), int(before), int(first)) for g, segs in self.segments.items() for pid, before, _, first in segs]
        if not seg:
            return self.rows.withColumn(out, F.lit(None).cast("bigint")).drop("_pid", "_loc")
        seg_df = spark.createDataFrame(seg, "_pid long, _g string, _before long, _first long")
        gexpr = F.col(self.group_col).cast("string") if self.group_col else F.lit(_NO_GROUP)
        joined = self.rows.withColumn("_g", gexpr).join(F.broadcast(seg_df), ["_pid", "_g"])  # ≤ partitions × groups rows
        return joined.withColumn(out, F.col("_before") + F.col("_loc") - F.col("_first") + F.lit(1)).drop(
            "_pid", "_loc", "_g", "_before", "_first"
        )


    def running_sum(self, cols: list[str], prefix: str = "cum_") -> DataFrame:
        """Inclusive running totals of ``cols`` in the index order (ungrouped
        index). Within a range partition: a window over that partition only
        (balanced by the range partitioner); across partitions: offsets from
        per-partition totals (≤ partitions rows, broadcast)."""
        spark = self.rows.sparkSession
        within = Window.partitionBy("_pid").orderBy("_loc").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        local = self.rows.withColumns({f"_l_{c}": F.sum(c).over(within) for c in cols})
        totals = sorted(self.rows.groupBy("_pid").agg(*[F.sum(c).alias(c) for c in cols]).collect())  # ≤ partitions
        acc = {c: 0 for c in cols}
        offsets = []
        for r in totals:
            offsets.append(tuple([int(r["_pid"])] + [float(acc[c]) for c in cols]))
            for c in cols:
                acc[c] += r[c] or 0
        off = spark.createDataFrame(offsets, ", ".join(["_pid long"] + [f"_o_{c} double" for c in cols]))
        joined = local.join(F.broadcast(off), "_pid")
        return joined.withColumns({f"{prefix}{c}": F.col(f"_l_{c}") + F.col(f"_o_{c}") for c in cols}).drop(
            "_pid", "_loc", *[f"_l_{c}" for c in cols], *[f"_o_{c}" for c in cols]
        )


def global_row_number(df: DataFrame, order_cols: list[str], out: str = "rn") -> DataFrame:
    """``row_number() OVER (ORDER BY order_cols)`` without a single-task window.
    ``order_cols`` must make the order total (end with a unique column)."""
    return OrderIndex(df, order_cols).with_position(out)


def _long_form(df: DataFrame, cols: list[str], tiebreak: Column) -> DataFrame:
    return df.select(tiebreak.alias("_tb"), *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        "_tb", cols, "_g", "_v"
    )


class Quantiles(dict):
    """{(col, p): value} plus ``rows`` (all rows) and ``non_null`` per column."""

    rows: int = 0
    non_null: dict = {}


def exact_quantiles(df: DataFrame, cols: list[str], probs: Iterable[float], tiebreak: str | None = None) -> Quantiles:
    """Exact linear-interpolated quantiles of several numeric columns with one
    range shuffle. NULL/NaN values are skipped (pandas ``quantile``); a column
    without values yields None. Also reports row and non-null counts, so a
    caller knows whether a column needs imputing without another pass."""
    probs = list(probs)
    tb = F.col(tiebreak) if tiebreak else F.monotonically_increasing_id()
    long = _long_form(df, cols, tb).withColumn("_v", F.when(~F.isnan(F.col("_v")), F.col("_v")))
    index = OrderIndex(long, ["_v", "_tb"], group_col="_g", value_col="_v")
    wanted: dict = {}
    plan = {}
    for c in cols:
        n = index.non_null.get(c, 0)
        for p in probs:
            if n == 0:
                plan[(c, p)] = None
                continue
            h = float(n - 1) * p
            lo = int(h // 1)
            hi = lo if h == lo else lo + 1
            plan[(c, p)] = (lo + 1, hi + 1, h - lo)
            wanted.setdefault(c, []).extend([lo + 1, hi + 1])
    rows = index.rows_at(wanted)
    result = Quantiles()
    result.rows = max(index.n.values()) if index.n else 0
    result.non_null = {c: index.non_null.get(c, 0) for c in cols}
    for (c, p), spec in plan.items():
        if spec is None:
            result[(c, p)] = None
            continue
        lo, hi, frac = spec
        a = rows[(c, lo)]["_v"]
        b = rows[(c, hi)]["_v"]
        result[(c, p)] = a if hi == lo else a + (b - a) * frac
    return result


def exact_medians(df: DataFrame, cols: list[str], tiebreak: str | None = None) -> dict:
    q = exact_quantiles(df, cols, [0.5], tiebreak)
    return {c: q[(c, 0.5)] for c in cols}


def quantile_bin_columns(df: DataFrame, cols: list[str], tiebreak: str, bins: int = 5) -> dict:
    """Column expressions giving, for each column, the bin 1..bins of pandas
    ``qcut(series.rank(method="first"), bins)``, ties ranked by ``tiebreak``.

    For n rows the row at 1-based rank r falls in bin
    ``1 + #{k in 1..bins-1 : r > floor((n-1)·k/bins) + 1}``; so only the
    bins−1 boundary keys (value, tie-break) per column are needed, found with
    one range shuffle, and binning is a projection. A single row gets the
    middle bin (the equal-width fallback of a constant series).
    """
    long = _long_form(df, cols, F.col(tiebreak))
    index = OrderIndex(long, ["_v", "_tb"], group_col="_g")
    wanted = {}
    for c in cols:
        n = index.count(c)
        if n >= 2:
            wanted[c] = [((n - 1) * k) // bins + 1 for k in range(1, bins)]
    rows = index.rows_at(wanted)
    out = {}
    for c in cols:
        n = index.count(c)
        if n < 2:
            out[c] = F.lit((bins + 1) // 2)
            continue
        v = F.col(c).cast("double")
        t = F.col(tiebreak)
        expr = F.lit(1)
        for pos in wanted[c]:
            r = rows[(c, pos)]
            bv, bt = F.lit(r["_v"]), F.lit(r["_tb"])
            expr = expr + F.when((v > bv) | ((v == bv) & (t > bt)), 1).otherwise(0)
        out[c] = expr
    return out
