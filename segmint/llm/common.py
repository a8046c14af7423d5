"""Helpers shared by the text operators: scratch tables in the shared folder,
free column names, words and shingles as NumPy arrays, state that a Python
worker keeps between tasks."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path

SHINGLE = 5
#: Odd multipliers of the shingle hash, one a word; any odd numbers do.
MULTIPLIERS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64
)


#: Rows of an Arrow batch between Spark and Python, at most: texts are long.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch size to ``BATCH_ROWS``."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back. It cuts lineage
    (a lost executor costs no recomputation) and gives Spark the true size."""
    small_batches(df.sparkSession)
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, names: Iterable[str]) -> dict[str, str]:
    """Column names for working columns that no column of ``df`` has."""
    have = {c.lower() for c in df.columns}
    out = {}
    for n in names:
        k = f"_{n}"
        while k.lower() in have:
            k = "_" + k
        have.add(k.lower())
        out[n] = k
    return out


def release() -> None:
    """Gives freed memory back to the system: workers outlive their tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(fn):
    """For functions over a task's Arrow batches: releases memory at the end."""

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            release()

    return run


def lean_group(fn):
    """The same for functions over the table of a group."""

    def run(table):
        try:
            return fn(table)
        finally:
            release()

    return run


def worker_state() -> dict:
    """A dict that lives as long as the Python worker process. Functions are
    shipped by value, so module globals do not outlive a task."""
    name = "segmint_worker_state"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
        sys.modules[name].state = {}
    return sys.modules[name].state


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased (bytes methods
    change and split on ASCII only)."""
    return text.lower().split() if text else []


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser with good avalanche over 64 bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hash_words(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_hashes(h: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hashes of the k-word windows of word hashes ``h`` in text order; the
    whole sequence as one if it is shorter; none for no words."""
    n = len(h)
    if n == 0:
        return np.empty(0, np.uint64)
    m = min(n, k)
    out = np.full(n - m + 1, m, np.uint64) * MULTIPLIERS[0]
    for j in range(m):
        out += h[j : n - m + 1 + j] * MULTIPLIERS[j]
    return mix(out)


def shingle_set(text: bytes | None) -> np.ndarray:
    """The distinct 5-word shingle hashes, ascending."""
    return np.unique(shingle_hashes(hash_words(words_of(text))))


def text_rows(batches, names: tuple[str, ...], rows: int = 512) -> Iterator[list]:
    """Arrow batches as lists of Python values, ``rows`` rows at a time, so
    that a batch of long texts is never expanded at once."""
    for b in batches:
        cols = [b.column(b.schema.get_field_index(n)) for n in names]
        for lo in range(0, b.num_rows, rows):
            yield [c.slice(lo, rows).to_pylist() for c in cols]


class Generations:
    """A bounded cache in two generations. When ``now`` is full it becomes
    ``old``; what is asked for again moves back, the rest goes."""

    def __init__(self, limit: int = 300_000):
        self.limit = limit
        self.now: dict = {}
        self.old: dict = {}

    def values(self, units: list[list], learn) -> list[list]:
        """The value of every unit. ``learn(list)`` gives the values of the
        units that neither generation has."""
        get = self.now.get
        found = [list(map(get, u)) for u in units]
        miss = {c for u, v in zip(units, found) if None in v for c, x in zip(u, v) if x is None}
        if miss:
            again = miss & self.old.keys()
            new = {c: self.old[c] for c in again}
            todo = list(miss - again)
            new.update(zip(todo, learn(todo)))
            if len(self.now) + len(new) > self.limit:
                self.old, self.now = self.now, {}
            self.now.update(new)
            for u, v in zip(units, found):
                if None in v:
                    v[:] = [new[c] if x is None else x for c, x in zip(u, v)]
        return found
