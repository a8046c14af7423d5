"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch holds the k smallest distinct hashes of a text's 5-word shingles
(words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased; with fewer words the whole
sequence is one shingle; without words the sketch is empty). Sketches of parts
merge into the sketch of the whole, and estimate resemblance (Jaccard),
containment and the number of distinct shingles. A sketch travels as base64
text of its hashes, ascending, eight little-endian bytes each.
"""

from __future__ import annotations

import base64

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, shingle_set, text_rows

K = 128
#: Rows of one block of the neighbour pass.
BLOCK_ROWS = 20_000


# ------------------------------------------------------------------ sketches
def sketch(text: bytes | None, k: int = K) -> np.ndarray:
    return shingle_set(text)[:k]


def to_text(s: np.ndarray) -> str:
    return base64.b64encode(s.astype("<u8").tobytes()).decode()


def from_text(t: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(t), "<u8")


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of the k smallest hashes of the union that both have (exact if
    neither text has more than k shingles). Two empty sketches are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    u = merge(a, b, k)
    top = u[-1]
    both = np.intersect1d(a[a <= top], b[b <= top], assume_unique=True)
    return len(both) / len(u)


def distinct(s: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles (exact below k)."""
    return float(len(s)) if len(s) < k else (k - 1) / ((float(s[k - 1]) + 1) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has. An empty a is contained."""
    if not len(a):
        return 1.0
    r = resemblance(a, b, k)
    return min(1.0, r * distinct(merge(a, b, k), k) / distinct(a, k))


# ----------------------------------------------------------------- operators
def sketch_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """(doc_id, fingerprint, n_shingles estimate) of every row."""
    import pyarrow as pa

    @lean
    def run(batches):
        for ids, texts in text_rows(batches, ("doc_id", "t")):
            s = [sketch(t, k) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([to_text(x) for x in s]), pa.array([distinct(x, k) for x in s])], names=["doc_id", "fingerprint", "shingles"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("t"))
    return narrow.mapInArrow(run, "doc_id long, fingerprint string, shingles double")


def merge_sketches(sketches: DataFrame, key: str, fingerprint: str = "fingerprint", k: int = K) -> DataFrame:
    """(key, fingerprint): the sketch of all texts of a key. Each task merges
    its own rows of a key first, so a hot key sends one sketch a task. The key
    is grouped as text; null keys form one group."""
    import pyarrow as pa

    schema = pa.schema([("key", pa.string()), ("fingerprint", pa.string())])

    @lean
    def partial(batches):
        have: dict = {}
        for keys, prints in text_rows(batches, ("key", "fingerprint"), 4096):
            for i, p in zip(keys, prints):
                s = from_text(p or "")
                have[i] = merge(have[i], s, k) if i in have else s
            if len(have) > 100_000:
                yield out(have)
                have = {}
        yield out(have)

    def out(have):
        return pa.RecordBatch.from_arrays([pa.array(list(have), pa.string()), pa.array([to_text(s) for s in have.values()], pa.string())], schema=schema)

    def total(t):
        s = np.empty(0, np.uint64)
        for p in t.column("fingerprint").to_pylist():
            s = merge(s, from_text(p), k)
        return pa.Table.from_arrays([t.column("key").slice(0, 1), pa.array([to_text(s)])], schema=schema)

    narrow = sketches.select(F.col(key).cast("string").alias("key"), F.col(fingerprint).alias("fingerprint"))
    return narrow.mapInArrow(partial, "key string, fingerprint string").groupBy("key").applyInArrow(total, "key string, fingerprint string")


def edit(text: str, following: str) -> str:
    """The last floor(n / 4) code points replaced by the first as many (or
    all) of the following text."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


def first_ids(d: DataFrame, cuts: np.ndarray) -> list[int]:
    """The smallest doc_id from each cut on, below the next cut. Quantiles are
    doubles, so beyond 2^53 a cut itself is seldom an id."""
    import pyarrow as pa

    @lean
    def run(batches):
        least = np.full(len(cuts) + 1, np.iinfo(np.int64).max)
        seen = np.zeros(len(cuts) + 1, bool)
        for b in batches:
            ids = b.column(0).drop_null().to_numpy()
            at = np.searchsorted(cuts, ids, side="right")
            np.minimum.at(least, at, ids)
            seen[at] = True
        at = 1 + np.flatnonzero(seen[1:])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(least[at])], names=["block", "doc_id"])

    if not len(cuts):
        return []
    least = d.select("doc_id").mapInArrow(run, "block int, doc_id long").groupBy("block").agg(F.min("doc_id").alias("doc_id"))
    return [r["doc_id"] for r in least.collect()]  # one id a block


def neighbours(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """(doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited,
    near_next) of every row, the next document being the next by (id, text);
    after the last one comes the first.

    Null ids come first, null texts are empty, rows that share an id follow
    one another by text. Texts are shuffled once, by blocks of ids; the first
    document of a block also goes to the block before, to follow its last."""
    import pyarrow as pa

    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    n = d.agg(F.count(F.lit(1)), F.count_if(F.col("doc_id").isNull()), F.min("doc_id")).first()
    if n[0] == 0:
        blocks, bounds = 1, []
    else:
        blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n[0] // BLOCK_ROWS))
        q = d.where(F.col("doc_id").isNotNull()).approxQuantile("doc_id", [i / blocks for i in range(1, blocks)], 1 / (4 * blocks)) if n[0] > n[1] else []
        first = [None] if n[1] else [n[2]]
        cuts = sorted({min(int(x), (1 << 63) - 1) for x in q if x is not None})
        bounds = first + sorted(set(first_ids(d, np.array(cuts, np.int64))) - set(first))
        blocks = len(bounds)
    real = [b for b in bounds[1:]]
    shared = spark.sparkContext.broadcast(np.array(real, np.int64))  # one id a block

    @lean
    def place(batches):
        starts = shared.value
        for ids, texts in text_rows(batches, ("doc_id", "t"), 1024):
            at = [0 if i is None else int(np.searchsorted(starts, i, side="right")) for i in ids]
            rows = [(b, 0, i, t) for b, i, t in zip(at, ids, texts)]
            rows += [((b - 1) % len(bounds), 1, i, t) for b, i, t in zip(at, ids, texts) if bounds[b] == i]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.string()))], names=["block", "head", "doc_id", "t"])

    @lean
    def run(batches):
        held: list = []  # the last row of the block so far: id, text, sketch
        out: list = []
        block, over = None, True

        def pair(cur):
            i, t, s = held
            e = edit(t, cur[1])
            es = sketch(e.encode("utf-8"), k)
            out.append((i, len(t), e, to_text(s), to_text(es), resemblance(s, es, k), resemblance(s, cur[2], k)))

        def flush():
            b = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
            out.clear()
            return b

        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        names = ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        for where, heads, ids, texts in text_rows(batches, ("block", "head", "doc_id", "t"), 256):
            for b, h, i, t in zip(where, heads, ids, texts):
                if b != block:
                    block, over, held = b, False, []
                if over:
                    continue  # further rows with the id of the next block's first
                cur = (i, t, sketch(t.encode("utf-8"), k))
                if held:
                    pair(cur)
                held, over = cur, bool(h)
            if out:
                yield flush()

    placed = d.mapInArrow(place, "block int, head int, doc_id long, t string").repartition(blocks, "block")
    ordered = placed.sortWithinPartitions("block", "head", F.asc_nulls_first("doc_id"), "t")
    return ordered.mapInArrow(run, "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
