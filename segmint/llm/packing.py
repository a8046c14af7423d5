"""Packing of documents into sequences of one length by column generation.

Documents become token ids and an end token; longer ones are cut at multiples
of the sequence length. The lengths of the pieces, in classes of ``WIDTH``
tokens, are a cutting-stock problem: a linear program over patterns (how many
pieces of each class a sequence takes), whose columns a knapsack dynamic
program prices. The plan is made on the driver from the histogram alone (at
most LENGTH / WIDTH classes, whatever the number of documents). Its rounded
patterns then go to the pieces by rank within their class, which is computed
in hash buckets, so that a class that holds a third of all pieces spreads
over many tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, materialize, text_rows
from .tokens import load_texts, tokenizer_path

LENGTH = 4096
#: Tokens a size class spans; a piece takes the room of its class's largest.
WIDTH = 8
END_ID = 2
#: The linear program ends when its value is proven this close to the least.
GAP = 1e-4
#: Pieces a rank bucket holds on average.
BUCKET_ROWS = 50_000


# --------------------------------------------------------------------- plan
def knapsack(value: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The best number of each item (any number of each) in ``room``."""
    best = np.zeros(room + 1)
    took = np.full(room + 1, -1, np.int64)
    good = np.flatnonzero(value > 0)
    s, v = sizes[good], value[good]
    order = np.argsort(s, kind="stable")
    s, v, good = s[order], v[order], good[order]
    upto = np.searchsorted(s, np.arange(room + 1), side="right")
    for w in range(1, room + 1):
        best[w], took[w] = best[w - 1], -1
        if upto[w]:
            gain = best[w - s[: upto[w]]] + v[: upto[w]]
            k = int(gain.argmax())
            if gain[k] > best[w] + 1e-12:
                best[w], took[w] = gain[k], k
    n = np.zeros(len(sizes), np.int64)
    w = room
    while w > 0:
        if took[w] < 0:
            w -= 1
        else:
            n[good[took[w]]] += 1
            w -= s[took[w]]
    return float(best[room]), n


def inverted(basis: np.ndarray) -> np.ndarray:
    """The inverse by elimination with row pivots. Like the steps below it
    calls no threaded linear algebra: such calls may not return in a driver
    that shares its process with the session's threads."""
    a = basis.copy()
    inv = np.eye(len(a))
    for k in range(len(a)):
        p = k + int(np.abs(a[k:, k]).argmax())
        if p != k:
            a[[k, p]], inv[[k, p]] = a[[p, k]], inv[[p, k]]
        inv[k] /= a[k, k]
        a[k] /= a[k, k]
        rows = np.flatnonzero(a[:, k])
        rows = rows[rows != k]
        factor = a[rows, k][:, None]
        a[rows] -= factor * a[k]
        inv[rows] -= factor * inv[k]
    return inv


def column_generation(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = GAP) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (one a row) and how often each is used (real numbers): the
    linear cutting-stock program by the revised simplex method. It starts from
    the patterns of one class each. A small fixed disturbance of the demand
    keeps degenerate steps from cycling."""
    m = len(sizes)
    need = demand * (1 + 1e-7 * np.cos(np.arange(1, m + 1)))
    basis = np.diag(room // sizes).astype(float)  # a column a pattern
    cost = np.ones(m)
    inverse = np.diag(1.0 / (room // sizes))
    x = need / (room // sizes)
    step = 0
    while True:
        dual = np.einsum("i,ij->j", cost, inverse)
        if dual.min() < -1e-9:  # too many of a class: its surplus enters
            c = int(dual.argmin())
            col, price = np.zeros(m), 0.0
            col[c] = -1
        else:
            best, n = knapsack(dual, sizes, room)
            bound = (dual * need).sum() / max(best, 1.0)  # Farley's bound
            if best <= 1 + 1e-9 or (x * cost).sum() <= bound * (1 + gap):
                break
            col, price = n.astype(float), 1.0
        d = np.einsum("ij,j->i", inverse, col)
        up = np.flatnonzero(d > 1e-9)
        ratio = x[up] / d[up]
        out = up[int(ratio.argmin())]
        t = max(float(x[out] / d[out]), 0.0)
        x -= t * d
        x[out] = t
        np.maximum(x, 0, out=x)
        basis[:, out], cost[out] = col, price
        pivot = inverse[out] / d[out]
        inverse -= np.outer(d, pivot)
        inverse[out] = pivot
        step += 1
        if step % 200 == 0:  # rounding errors do not add up
            inverse = inverted(basis)
            x = np.maximum(np.einsum("ij,j->i", inverse, need), 0)
    real = cost > 0
    return basis[:, real].T.round().astype(np.int64), x[real]


def integer_patterns(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = GAP) -> list[tuple[np.ndarray, int]]:
    """(pattern, times) that hold every piece: the program's patterns rounded
    down, then patterns for what is left, each the fullest that the rest
    allows, largest pieces first."""
    left = demand.astype(np.int64).copy()
    plan = []
    patterns, uses = column_generation(sizes, demand.astype(float), room, gap)
    for k in np.argsort(-uses, kind="stable"):
        p = patterns[k]
        has = p > 0
        times = min(int(np.floor(uses[k] + 1e-6)), int((left[has] // p[has]).min()) if has.any() else 0)
        if times > 0:
            plan.append((p.copy(), times))
            left -= times * p
    while left.any():
        p, free = np.zeros(len(sizes), np.int64), room
        for c in np.argsort(-sizes, kind="stable"):
            n = min(int(left[c]), free // int(sizes[c]))
            if n:
                p[c] = n
                free -= n * int(sizes[c])
        has = p > 0
        times = int((left[has] // p[has]).min())
        plan.append((p, times))
        left -= times * p
    return plan


def slots(classes: np.ndarray, plan: list[tuple[np.ndarray, int]]) -> dict[int, np.ndarray]:
    """class -> rows (first rank, pieces a sequence, first sequence, place in
    the sequence): where a piece goes by its rank in the class."""
    out: dict[int, list] = {int(c): [] for c in classes}
    rank = dict.fromkeys(out, 0)
    base = 0
    for p, times in plan:
        place = 0
        for k in np.flatnonzero(p):
            c = int(classes[k])
            out[c].append((rank[c], int(p[k]), base, place))
            rank[c] += int(p[k]) * times
            place += int(p[k])
        base += times
    return {c: np.array(v, np.int64).reshape(-1, 4) for c, v in out.items()}


# ------------------------------------------------------------------- pieces
def pieces(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = END_ID, length: int = LENGTH) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids): the token ids of every row
    (a null text is empty) and ``end_id``, cut at multiples of ``length``;
    ``ids`` are little-endian unsigned 32-bit integers."""
    import pyarrow as pa

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("t"))

    @lean
    def run(batches):
        encoder = load_texts(path or tokenizer_path())
        for doc_ids, texts in text_rows(batches, ("doc_id", "t")):
            rows = []
            for i, ids in zip(doc_ids, encoder.encode(texts)):
                data = ids.tobytes() + np.uint32(end_id).tobytes()
                n = len(data) // 4
                rows += [(i, s, min(length, n - s), n, data[4 * s : 4 * (s + length)]) for s in range(0, n, length)]
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "start", "length", "doc_tokens", "ids"])

    return narrow.mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, ids binary")


def assign(cut: DataFrame, length: int = LENGTH, width: int = WIDTH, gap: float = GAP) -> DataFrame:
    """Adds sequence_id (from 0) and offset (gapless from 0 within each
    sequence) to pieces with ``doc_id``, ``start`` and ``length``. ``cut``
    must be a written table: it is read for the histogram and again."""
    import pyarrow as pa

    spark = cut.sparkSession
    sized = cut.withColumn("_class", F.ceil(F.col("length") / width).cast("int"))
    hist = sized.groupBy("_class").agg(F.count(F.lit(1)).alias("n")).orderBy("_class").collect()  # at most length / width rows
    classes = np.array([r["_class"] for r in hist], np.int64)
    demand = np.array([r["n"] for r in hist], np.int64)
    where = slots(classes, integer_patterns(classes, demand, length // width, gap)) if len(hist) else {}
    shared = spark.sparkContext.broadcast(where)  # bounded by patterns x classes in a pattern

    buckets = max(32, int(demand.sum()) // BUCKET_ROWS)
    sized = sized.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)).cast("int"))
    counts = sized.groupBy("_class", "_bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("_class").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("_class", "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_class", "_bucket").orderBy("doc_id", "start"))
    ranked = sized.withColumn("_own", own).join(counts, ["_class", "_bucket"])
    ranked = ranked.withColumn("_rank", (F.col("_before") + F.col("_own") - 1).cast("long")).drop("_before", "_own", "_bucket")
    names = [c for c in ranked.columns if c not in ("_class", "_rank")]

    @lean
    def run(batches):
        table = shared.value
        for b in batches:
            cls = b.column(b.schema.get_field_index("_class")).to_numpy(zero_copy_only=False)
            rank = b.column(b.schema.get_field_index("_rank")).to_numpy(zero_copy_only=False)
            seq, place = np.zeros(len(cls), np.int64), np.zeros(len(cls), np.int64)
            for c in np.unique(cls):
                own = np.flatnonzero(cls == c)
                t = table[int(c)]
                row = t[np.searchsorted(t[:, 0], rank[own], side="right") - 1]
                k = rank[own] - row[:, 0]
                seq[own] = row[:, 2] + k // row[:, 1]
                place[own] = row[:, 3] + k % row[:, 1]
            cols = [b.column(b.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(seq), pa.array(place)], names=[*names, "sequence_id", "_place"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name in names)
    placed = ranked.mapInArrow(run, fields + ", sequence_id long, _place long")
    in_sequence = Window.partitionBy("sequence_id").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)  # at most length / width pieces
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(in_sequence), F.lit(0)).cast("long")).drop("_place")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: dict[str, Column] | None = None, **options) -> DataFrame:
    """One row a piece: doc_id, start, length, doc_tokens, the columns
    ``keep`` (made from ``ids``; the ids themselves by default), sequence_id
    and offset. Other columns of ``docs`` do not matter; rows with null or
    equal ids are packed each for itself; an empty table gives no rows."""
    cut = pieces(docs, id_col, text, **options)
    keep = {"ids": F.col("ids")} if keep is None else keep
    return assign(materialize(cut.select("doc_id", "start", "length", "doc_tokens", *[c.alias(k) for k, c in keep.items()]), "pieces"))
