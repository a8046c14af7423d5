"""Token counts by a map-side look-up in two tiers.

The lengths of the most frequent pre-tokens of the corpus are a compact table
(ascending hashes and small integers) that every task gets. What it lacks is
encoded once per worker and kept in the worker's bounded table. Pre-tokens
are never shuffled. The frequent ones come from a summary of bounded size per
task over all texts; only summaries are merged, ``FAN_IN`` at a time.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, lean_group, materialize, text_rows
from .tokens import PreTokens, load_texts, tokenizer_path

#: Pre-tokens in the broadcast table (10 bytes each).
FREQUENT = 65_536
#: Pre-tokens that a summary holds while and after it is made.
SUMMARY, WORKING = 65_536, 262_144
FAN_IN = 32
#: Longer pre-tokens are left to the workers' tables.
LONGEST = 64


class Summary:
    """Counts of the most frequent pre-tokens seen (counters of the least
    frequent are dropped when there are too many), with their bytes."""

    def __init__(self):
        self.hashes, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.words: dict[int, bytes] = {}

    def add(self, hashes: np.ndarray, counts: np.ndarray, words, least: int = 1) -> None:
        """``words(k)``: the bytes of the k-th hash."""
        known = set(self.words)
        for k in np.flatnonzero(counts >= least):
            h = int(hashes[k])
            if h not in known:
                self.words[h] = words(k)
        both = np.concatenate([self.hashes, hashes])
        self.hashes, inverse = np.unique(both, return_inverse=True)
        self.counts = np.bincount(inverse, np.concatenate([self.counts, counts]).astype(float)).astype(np.int64)
        if len(self.hashes) > 2 * WORKING:
            self.cut(WORKING)

    def cut(self, size: int) -> None:
        if len(self.hashes) > size:
            keep = np.sort(np.lexsort((self.hashes, -self.counts))[:size])
            self.hashes, self.counts = self.hashes[keep], self.counts[keep]
        have = set(self.hashes.tolist())
        self.words = {h: w for h, w in self.words.items() if h in have}

    def row(self) -> dict:
        named = np.array([h in self.words for h in self.hashes.tolist()], bool)
        self.hashes, self.counts = self.hashes[named], self.counts[named]
        self.cut(SUMMARY)
        words = [self.words[h] for h in self.hashes.tolist()]
        return {"hashes": self.hashes.tobytes(), "counts": self.counts.tobytes(), "words": b"\n".join(words)}

    def merge(self, row: dict) -> None:
        words = row["words"].split(b"\n") if row["words"] else []
        self.add(np.frombuffer(row["hashes"], np.uint64), np.frombuffer(row["counts"], np.int64), words.__getitem__)


SCHEMA = "part long, hashes binary, counts binary, words binary"


def frequent_pretokens(docs: DataFrame, text: str = "text") -> list[bytes]:
    """The most frequent pre-tokens of all plain texts, at most ``FREQUENT``."""
    import pyarrow as pa

    narrow = docs.select(F.col(text).cast("string").cast("binary").alias("t"))

    @lean
    def summarise(batches):
        from pyspark import TaskContext

        s, encoder = Summary(), load_texts(tokenizer_path())
        for (texts,) in text_rows(batches, ("t",)):
            for which in encoder.plain_batches(texts):
                p = PreTokens([texts[k] for k in which])
                u, at, n = np.unique(p.hashes, return_index=True, return_counts=True)
                short = p.sizes[at] <= LONGEST
                u, at, n = u[short], at[short], n[short]
                s.add(u, n, lambda k: p.data[p.starts[at[k]] : p.starts[at[k]] + p.sizes[at[k]]].tobytes(), least=3)
        yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId()} | s.row()], schema=arrow)

    @lean_group
    def merge(t):
        s = Summary()
        for row in t.to_pylist():
            s.merge(row)
        return pa.Table.from_pylist([{"part": t.column("part")[0].as_py() // FAN_IN} | s.row()], schema=arrow)

    arrow = pa.schema([("part", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary()), ("words", pa.binary())])
    parts = materialize(narrow.mapInArrow(summarise, SCHEMA), "token-summaries")
    rows = parts.count()
    while True:
        parts = parts.groupBy(F.expr(f"part div {FAN_IN}").alias("to")).applyInArrow(merge, SCHEMA)
        rows = -(-rows // FAN_IN)
        if rows <= 1:
            break
    s = Summary()
    for r in parts.collect():  # one summary
        s.merge(r.asDict())
    s.cut(FREQUENT)
    return [s.words[h] for h in s.hashes.tolist()]


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; a null text is
    empty. Texts need not be plain: the others skip the first tier."""
    import pyarrow as pa

    words = frequent_pretokens(docs, text)
    encoder = load_texts(path or tokenizer_path())
    _, counts = encoder.chunks.merges.encode_words(words)
    hashes = PreTokens([b" ".join(words)]).hashes if words else np.empty(0, np.uint64)
    order = np.argsort(hashes)
    shared = docs.sparkSession.sparkContext.broadcast((hashes[order], counts[order].astype(np.uint16)))
    narrow = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).cast("string").cast("binary").alias("t")
    )

    @lean
    def run(batches):
        encoder = load_texts(path or tokenizer_path())
        for ids, n_bytes, texts in text_rows(batches, ("doc_id", "n_bytes", "t")):
            n = encoder.count(texts, shared.value)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(n)], names=["doc_id", "n_bytes", "n_tokens"])

    return narrow.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
