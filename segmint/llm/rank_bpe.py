"""Byte-level BPE by a file of ranks, with recursive DuckDB queries in each
partition.

A task cuts its texts by the pattern and looks for the distinct words in a
bounded table of those that the worker has met. New ones become rows (word,
pos, tok), one a byte. Every
step of a recursive query joins adjacent tokens with the merge table and
contracts, in each word, the leftmost pair of the lowest rank, until no word
has such a pair. Decoding joins token rows with the vocabulary and aggregates
their bytes in order of position. No shuffle takes place, and DuckDB holds
the words or tokens of one batch of texts alone.
"""

from __future__ import annotations

import base64
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import PlainRuns, is_plain
from .common import fresh, lean, worker_state
from .pretokens import Runs, Table, cut_long, ragged

RANKS = "byte_bpe_50k.tiktoken"
#: Bytes of text whose words or tokens DuckDB holds at once.
BATCH_BYTES = 2 << 20
#: Words up to this many bytes share one query, in slices of ``SLICE`` bytes.
SHORT = 64
SLICE = 1 << 19
#: Tokens decoded at once.
STEP_TOKENS = 1 << 19
#: Most memory that a worker's DuckDB may take; only very long words need it.
MEMORY = "1GB"

#: All rows of the words that are not finished go through each step; a word
#: comes out (``NOT alive``) when no pair of it is in the merge table.
CONTRACT = """
WITH RECURSIVE step(word, pos, tok, alive) AS (
  SELECT word, pos, tok, true FROM bytes_of_words
  UNION ALL
  (WITH beside AS (
     SELECT word, pos, tok, lead(tok) OVER w AS nxt, lead(pos) OVER w AS nxt_pos
     FROM step WHERE alive WINDOW w AS (PARTITION BY word ORDER BY pos)),
   pairs AS (
     SELECT b.word, b.pos, b.tok, b.nxt_pos, m.made FROM beside b LEFT JOIN merges m ON m.l = b.tok AND m.r = b.nxt),
   least AS (
     SELECT word, min(made) AS made, arg_min(pos, (made::BIGINT << 32) + pos) AS pos, arg_min(nxt_pos, (made::BIGINT << 32) + pos) AS gone
     FROM pairs WHERE made IS NOT NULL GROUP BY word)
   SELECT p.word, p.pos, CASE WHEN p.pos = l.pos THEN l.made ELSE p.tok END, l.word IS NOT NULL
   FROM pairs p LEFT JOIN least l ON l.word = p.word WHERE l.gone IS NULL OR p.pos <> l.gone)
)
SELECT word, list(tok ORDER BY pos) AS ids FROM step WHERE NOT alive GROUP BY word ORDER BY word
"""

#: The same for long words. Rows are kept by key, so memory stays linear, and
#: a step contracts every occurrence of the pair, left to right, where the
#: merged token is part of no merge of lower rank (``many``): then no new pair
#: can come before the next occurrence. Of a run such as aaaa, whose pairs
#: overlap, that is every second pair.
CONTRACT_LONG = """
WITH RECURSIVE step(word, pos, tok) USING KEY (word, pos) AS (
  SELECT word, pos, tok FROM bytes_of_words
  UNION
  (WITH beside AS (
     SELECT word, pos, tok, lead(tok) OVER w AS nxt, lead(pos) OVER w AS nxt_pos
     FROM recurring.step WHERE tok >= 0 AND word IN (SELECT word FROM step)
     WINDOW w AS (PARTITION BY word ORDER BY pos)),
   pairs AS (
     SELECT b.word, b.pos, b.nxt_pos, m.made, m.many FROM beside b JOIN merges m ON m.l = b.tok AND m.r = b.nxt),
   least AS (SELECT word, min(made) AS made FROM pairs GROUP BY word),
   hits AS (
     SELECT p.*, row_number() OVER w AS n, lag(p.nxt_pos) OVER w IS DISTINCT FROM p.pos AS opens
     FROM pairs p JOIN least USING (word, made) WINDOW w AS (PARTITION BY p.word ORDER BY p.pos)),
   runs AS (SELECT *, max(CASE WHEN opens THEN n END) OVER (PARTITION BY word ORDER BY pos) AS first FROM hits)
   SELECT word, unnest([pos, nxt_pos]), unnest([made, -1]) FROM runs
   WHERE CASE WHEN many THEN (n - first) % 2 = 0 ELSE n = 1 END)
)
SELECT word, list(tok ORDER BY pos) AS ids FROM step WHERE tok >= 0 GROUP BY word ORDER BY word
"""

DECODE = """
SELECT doc, list(piece ORDER BY pos) AS pieces FROM tokens JOIN vocabulary USING (id) GROUP BY doc ORDER BY doc
"""


def list_values(column) -> tuple[np.ndarray, object]:
    """(sizes of the lists, their values one after another) of an Arrow list
    column."""
    import pyarrow as pa

    one = column.combine_chunks()
    if isinstance(one, pa.ChunkedArray):
        one = pa.concat_arrays(one.chunks) if one.num_chunks else pa.array([], one.type)
    return np.diff(one.offsets.to_numpy()), one.flatten()


class RankBpe:
    """A rank file: merge table and vocabulary in DuckDB, known words."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import pyarrow as pa
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        rules = [(ranks[t[:c]], ranks[t[c:]], r) for t, r in ranks.items() for c in range(1, len(t)) if t[:c] in ranks and t[c:] in ranks]
        rows = np.array(rules, np.int32).reshape(-1, 3)
        left, right, made = rows[:, 0], rows[:, 1], rows[:, 2]
        early = np.unique(np.r_[left[made < left], right[made < right]])
        # everything stays in memory: no folder of this machine is used
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        self.put("rules", l=left, r=right, made=made, many=~np.isin(made, early))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM rules").complete()
        self.put("pieces", id=np.fromiter(ranks.values(), np.int32, len(ranks)), piece=pa.array(list(ranks), pa.binary()))
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM pieces").complete()
        for name in ("rules", "pieces"):
            self.db.unregister(name)
        self.table = Table(self)

    def put(self, name: str, **columns) -> None:
        import pyarrow as pa

        self.db.register(name, pa.table(columns))

    def encode_flat(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, number of ids of each word);
        ``data`` holds the words' bytes one after another."""
        starts = np.cumsum(sizes) - sizes
        counts = np.zeros(len(sizes), np.int64)
        out: list = [np.empty(0, np.int32)] * len(sizes)
        short = np.flatnonzero(sizes <= SHORT)
        slices = np.split(short, np.flatnonzero(np.diff(np.cumsum(sizes[short]) // SLICE)) + 1) if len(short) else []
        for query, group in [*((CONTRACT, s) for s in slices), *((CONTRACT_LONG, np.array([k])) for k in np.flatnonzero(sizes > SHORT))]:
            n = sizes[group]
            self.put(
                "bytes_of_words",
                word=np.repeat(np.arange(len(group), dtype=np.int32), n),
                pos=ragged(np.zeros(len(group), np.int64), n).astype(np.int32),
                tok=self.byte_ids[data[ragged(starts[group], n)]],
            )
            c, ids = list_values(self.db.sql(query).to_arrow_table().column("ids"))
            self.db.unregister("bytes_of_words")
            counts[group] = c
            for k, v in zip(group.tolist(), np.split(ids.to_numpy(), np.cumsum(c)[:-1])):
                out[k] = v
        return np.concatenate([*out, np.empty(0, np.int32)]), counts

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """uint32 ids of each text."""
        out: list = [np.empty(0, np.uint32)] * len(texts)
        pieces, owner = cut_long(texts)
        plain = [k for k, t in enumerate(pieces) if t and is_plain(t)]
        other = [k for k, t in enumerate(pieces) if t and not is_plain(t)]
        found: list = [np.empty(0, np.uint32)] * len(pieces)
        for which, runs in ((plain, PlainRuns), (other, self.pattern_runs)):
            for lo, hi in parts([pieces[k] for k in which]):
                ids = self.table.texts(runs([pieces[k] for k in which[lo:hi]]))
                for k, v in zip(which[lo:hi], ids):
                    found[k] = v
        for k, v in zip(owner, found):
            out[k] = v if not len(out[k]) else np.concatenate([out[k], v])
        return out

    def pattern_runs(self, texts: list[bytes]) -> Runs:
        """The pre-tokens of any texts; every character lies in a match."""
        words = [[w.encode("utf-8") for w in self.pattern.findall(t.decode("utf-8", "replace"))] for t in texts]
        sizes = np.array([len(w) for ws in words for w in ws], np.int64)
        ends = np.cumsum(sizes)
        begins = np.r_[0, np.cumsum([sum(map(len, ws)) for ws in words])]
        return Runs(np.frombuffer(b"".join(w for ws in words for w in ws), np.uint8), ends - sizes, ends, begins)

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each list of ids. An id that the vocabulary does not
        have is an error."""
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.concatenate([*ids, np.empty(0, np.uint32)])
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        out: list[list[bytes]] = [[] for _ in ids]
        for lo in range(0, len(flat), STEP_TOKENS):
            part = slice(lo, min(lo + STEP_TOKENS, len(flat)))
            self.put("tokens", doc=doc[part], pos=np.arange(part.start, part.stop), id=flat[part])
            found = self.db.sql(DECODE).to_arrow_table()
            self.db.unregister("tokens")
            n, pieces = list_values(found.column("pieces"))
            if n.sum() != part.stop - part.start:
                raise ValueError("an id is not in the vocabulary")
            at = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1]
            ends = at[np.r_[0, np.cumsum(n)]].tolist()
            data = pieces.buffers()[2]
            for k, x, y in zip(found.column("doc").to_pylist(), ends[:-1], ends[1:]):
                out[k].append(data[x:y].to_pybytes())
        return [b"".join(x) for x in out]


def load(path: str, pattern: str) -> RankBpe:
    state = worker_state()
    if ("rank_bpe", path, pattern) not in state:
        state[("rank_bpe", path, pattern)] = RankBpe(path, pattern)
    return state[("rank_bpe", path, pattern)]


def defaults() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(RANKS), public_tokenizers.PATTERN


def parts(texts: list[bytes], size: int = BATCH_BYTES):
    """(first, end) of runs of texts of about ``size`` bytes."""
    lo, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t)
        if held >= size:
            yield lo, k + 1
            lo, held = k + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


Finish = tuple[str, Callable[[list, list], list]]


def round_trip(docs: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None, finish: Finish | None = None) -> DataFrame:
    """Adds ``ids`` (array<int>) and ``decoded`` (binary: the bytes decoded
    from those ids) to every row.

    Null texts count as empty and have no ids; repeated rows and rows with
    null keys stay, each with its own result; an empty table gives no rows;
    an existing column of either name is a ``ValueError``. Texts of any
    length are encoded whole; a worker holds one batch of texts and
    the words it remembers.

    ``finish`` = (DDL, function of (ids, decoded) -> Arrow arrays) puts other
    columns in the place of the two, computed in the same task, where ids and
    bytes need not leave it. ``path`` must exist on the executors; None takes
    the installed public file and its pattern."""
    import pyarrow as pa

    ddl = finish[0] if finish else "ids array<int>, decoded binary"
    made = [f.split()[0] for f in ddl.split(",")]
    if {m.lower() for m in made} & {c.lower() for c in docs.columns}:
        raise ValueError("an output column exists already")
    t = fresh(docs, ["t"])["t"]
    own = docs.columns

    def plain(ids, decoded):
        flat = pa.array(np.concatenate([*ids, np.empty(0, np.uint32)]).view(np.int32))
        return [pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(x) for x in ids]), pa.int32()), flat), pa.array(decoded, pa.binary())]

    columns = finish[1] if finish else plain

    @lean
    def run(batches):
        at = defaults()
        bpe = load(path or at[0], pattern or at[1])
        for b in batches:
            texts = b.column(b.schema.get_field_index(t))
            for first in range(0, b.num_rows, 256):
                held = [x or b"" for x in texts.slice(first, 256).to_pylist()]
                for lo, hi in parts(held):
                    ids = bpe.encode(held[lo:hi])
                    cols = columns(ids, bpe.decode(ids))
                    part = b.slice(first + lo, hi - lo)
                    yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in own), *cols], names=[*own, *made])

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.withColumn(t, F.col(text).cast("string").cast("binary")).mapInArrow(run, f"{fields}, {ddl}")
