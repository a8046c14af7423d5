"""Removal of passages that repeat across documents.

Two kinds of units are compared, all over whole texts:

* *Passages.* A text is cut at content-defined places: a word is a cut where
  the hash of it and the next word is the smallest of any ``SPAN`` neighbours.
  Every cut begins a unit of at least ``SPAN`` words that ends at the next cut
  far enough on, so units overlap, are at most twice ``SPAN`` long, and do not
  depend on what surrounds a passage or where its lines break: of any 51 words
  that two texts share, at least one unit is the same in both. A second set of
  units has line starts as cuts too, for whole lines. Equal units (by hash) are
  duplicates. Around them a second pass compares all windows of ``SPAN`` words,
  so that a shared passage is covered from its first word to its last one.
* *Paragraphs.* Lines of at least ``LEAST_WORDS`` words, and joined lines of
  hard-wrapped paragraphs (lines of at most ``WRAPPED`` words one below another,
  up to a blank or longer line) with as many words, get MinHash signatures of
  their 5-word shingles, cut into bands that ``tune_bands`` chooses for a
  high recall; paragraphs that collide in a band are verified by their exact
  Jaccard similarity, and verified pairs are clustered by components. First a
  star and a chain of each band key are verified; then, in blocks, all pairs of
  a key that are still in different components.

Of each duplicated unit the document with the smallest id keeps its words
(rows without an id come last). Elsewhere the units go, where together they
cover at least ``LEAST_WORDS`` words in a run.

A key is sent once per task, with the smallest document id that has it there;
the other documents of the task wait in a table of their own. So a passage
that a third of all documents share is a few rows for the reducers.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MULTIPLIERS, SHINGLE, fresh, hash_words, lean, lean_group, materialize, mix, text_rows
from .components import connected_components
from .pretokens import powers

SPAN = 12
LEAST_WORDS = 20
#: Shared words beside an equal unit, at most: with more there were another one.
REACH = 50
#: Words of a line of a hard-wrapped paragraph, at most; longer lines are
#: paragraphs themselves.
WRAPPED = 40
THRESHOLD = 0.8
RECALL = 0.99
#: Index entries a reducer handles on average.
BUCKET_ENTRIES = 1_000_000
FILTER_BITS = 1 << 26
#: Paragraphs of a band key that meet in one task; larger groups go in blocks.
BLOCK = 2048
#: The document id that rows without one take: after all others.
NO_ID = (1 << 63) - 1


def tune_bands(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = 3) -> tuple[int, int]:
    """(bands, rows): the fewest bands of ``rows`` hashes that find a pair at
    the threshold with the wanted probability."""
    bands = 1
    while 1 - (1 - threshold**rows) ** bands < recall:
        bands += 1
    return bands, rows


# -------------------------------------------------------------------- units
def covered(lo: np.ndarray, hi: np.ndarray, n: int) -> np.ndarray:
    """Which of the numbers below n the ranges [lo, hi) cover."""
    change = np.bincount(lo, minlength=n + 1) - np.bincount(hi, minlength=n + 1)
    return np.cumsum(change[:n]) > 0


class Words:
    """Word hashes of some texts, one after another: ``h``, ``docs`` (first
    word of each text, and the number of words), ``lines`` (starts, ends of
    lines with words) with ``line_doc`` and ``apart`` (first of a text or
    below a blank line)."""

    def __init__(self, texts: list[bytes | None]):
        words: list[bytes] = []
        docs, starts, line_doc, apart = [0], [], [], []
        for k, t in enumerate(texts):
            if t:
                gap = True
                for line in t.lower().split(b"\n"):
                    own = line.split()
                    if own:
                        starts.append(len(words))
                        line_doc.append(k)
                        apart.append(gap)
                        words += own
                    gap = not own
            docs.append(len(words))
        self.h = hash_words(words)
        self.docs = np.array(docs)
        self.starts = np.array(starts, np.int64)
        self.ends = np.array([*starts[1:], len(words)], np.int64)[: len(starts)]
        self.line_doc = np.array(line_doc, np.int64)
        self.apart = np.array(apart, bool)
        n = len(words)
        up, self.down = powers(n + 1)
        self.run = np.r_[np.uint64(0), np.cumsum(self.h * up[:n])]

    def key(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Hashes of the word runs [lo, hi)."""
        return mix((self.run[hi] - self.run[lo]) * self.down[lo] + (hi - lo).astype(np.uint64))

    def cut_at(self, soft: np.ndarray, hard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lo, hi) of the units between the cuts."""
        cuts = np.union1d(soft, hard)
        ends = np.searchsorted(cuts, cuts + SPAN)
        lo, hi = cuts[ends < len(cuts)], cuts[ends[ends < len(cuts)]]
        # and back from each forced cut, so that what ends there is covered whole
        back = np.searchsorted(cuts, hard - SPAN, side="right") - 1
        return np.r_[lo, cuts[back[back >= 0]]], np.r_[hi, hard[back >= 0]]

    def units(self, alone: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, lo, hi) of the passages: those of the hash cuts alone, and
        those of a second set with line starts as cuts too. ``alone``: as if
        each text had been given by itself."""
        n = len(self.h)
        none = np.empty(0, np.int64)
        if n < SPAN:
            return none, none, none
        after = np.r_[self.h[1:], np.uint64(0)]
        if alone:
            after[self.docs[self.docs > 0] - 1] = 0
        g = mix(self.h * MULTIPLIERS[0] + after * MULTIPLIERS[1])
        at = np.arange(n - SPAN + 1)
        least = at + np.lib.stride_tricks.sliding_window_view(g, SPAN).argmin(axis=1)
        if alone:
            least = least[at + SPAN <= self.docs[np.searchsorted(self.docs, at, side="right")]]
        soft = np.unique(least)
        sets = [self.cut_at(soft, np.unique(self.docs)), self.cut_at(soft, np.r_[self.starts, n])]
        both = np.unique(np.concatenate([lo * (4 * SPAN) + (hi - lo) for lo, hi in sets]))
        lo = both // (4 * SPAN)
        hi = lo + both % (4 * SPAN)
        # no unit reaches from one text into the next
        doc = np.searchsorted(self.docs, lo, side="right") - 1
        ok = hi <= self.docs[doc + 1]
        return doc[ok], lo[ok], hi[ok]

    def edges(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, start) of the windows of ``SPAN`` words that reach out of
        what the units cover, as far as ``REACH`` words."""
        inside = covered(lo, hi, len(self.h) + 1)
        step = np.diff(np.r_[False, inside].astype(np.int8))
        a, b = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        last = max(len(self.h) - SPAN + 1, 0)
        at = np.flatnonzero(covered(np.clip(np.r_[a - REACH, b - SPAN + 1], 0, last), np.clip(np.r_[a, b - SPAN + REACH + 1], 0, last), last))
        doc = np.searchsorted(self.docs, at, side="right") - 1
        ok = at + SPAN <= self.docs[doc + 1]
        return doc[ok], at[ok]

    def paragraphs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, lo, hi) of the long lines and of the wrapped paragraphs."""
        if not len(self.starts):
            return self.line_doc, self.starts, self.ends
        long = self.ends - self.starts > WRAPPED
        first = np.flatnonzero(self.apart | long | np.r_[False, long[:-1]])
        last = np.r_[first[1:], len(long)] - 1
        first, last = first[last > first], last[last > first]
        doc = np.r_[self.line_doc, self.line_doc[first]]
        lo, hi = np.r_[self.starts, self.starts[first]], np.r_[self.ends, self.ends[last]]
        ok = hi - lo >= LEAST_WORDS
        return doc[ok], lo[ok], hi[ok]

    def shingles(self) -> np.ndarray:
        """The hash of the 5 words from each word on (meaningless near the
        end of a line)."""
        n = len(self.h)
        out = np.full(n, SHINGLE, np.uint64) * MULTIPLIERS[0]
        for j in range(SHINGLE):
            out[: n - j] += self.h[j:] * MULTIPLIERS[j]
        return mix(out)

    def band_keys(self, lo: np.ndarray, hi: np.ndarray, bands: int, rows: int) -> np.ndarray:
        """(bands, lines) keys of the lines [lo, hi)."""
        if not len(lo):
            return np.empty((bands, 0), np.uint64)
        n = hi - lo - SHINGLE + 1
        ends = np.cumsum(n)
        idx = np.repeat(lo - (ends - n), n) + np.arange(ends[-1])
        s = self.shingles()[idx]
        first = ends - n
        out = np.zeros((bands, len(lo)), np.uint64)
        odd = mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * MULTIPLIERS[2]) | np.uint64(1)
        for b in range(bands):
            for r in range(rows):
                least = np.minimum.reduceat(s * odd[b * rows + r], first)
                out[b] += mix(least) * MULTIPLIERS[r]
            out[b] = mix(out[b] + np.uint64(b))
        return out


# ------------------------------------------------------------------- pass 1
def _blob(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def planes(a: np.ndarray) -> bytes:
    """8-byte numbers byte by byte: first all their first bytes, and so on.
    The high bytes of ids and of sorted keys repeat, so Spark packs them."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(blob: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view(kind).ravel()


def collapse(keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entries (key, owner) as (distinct keys, smallest owner, whether there
    are several) and (key, owner) of the other owners."""
    order = np.lexsort((owners, keys))
    keys, owners = keys[order], owners[order]
    first = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.empty(0, bool)
    other = ~first & np.r_[False, (owners[1:] != owners[:-1]) | first[1:]] if len(keys) else first
    starts = np.flatnonzero(first)
    several = np.logical_or.reduceat(other, starts) if len(starts) else other
    return keys[first], owners[first], several, keys[other], owners[other]


def entry_blocks(kind: int, keys: list, owners: list, buckets: int) -> list[tuple]:
    """Rows of the table of blocks: entries by bucket, and the other owners."""
    k, o, several, more_k, more_o = collapse(np.concatenate([np.empty(0, np.uint64), *keys]), np.concatenate([np.empty(0, np.int64), *owners]))
    at = ((k >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    ends = np.searchsorted(at, np.arange(buckets + 1))
    out = [(kind, b, planes(k[lo:hi]), planes(o[lo:hi]), _blob(several[lo:hi])) for b, (lo, hi) in enumerate(zip(ends[:-1], ends[1:])) if hi > lo]
    return [*out, (kind + 2, 0, planes(more_k), planes(more_o), b"")] if len(more_k) else out


def index(docs: DataFrame, buckets: int, bands: int, rows: int) -> DataFrame:
    """A written table of blocks: kind 0 passages (key, document), 1 bands
    (key, line hash), by bucket; kind 2 and 3 the other owners of a task."""
    import pyarrow as pa

    names, types = ["kind", "bucket", "keys", "owners", "several"], (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())

    @lean
    def run(batches):
        held: list = [[], [], [], []]
        size = 0

        def flush():
            out = [r for kind in (0, 1) for r in entry_blocks(kind, held[2 * kind], held[2 * kind + 1], buckets)]
            for x in held:
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names) if out else None

        for ids, texts in text_rows(batches, ("d", "t")):
            d = np.array(ids, np.int64)
            w = Words(texts)
            doc, lo, hi = w.units()
            held[0].append(w.key(lo, hi))
            held[1].append(d[doc])
            _, lo, hi = w.paragraphs()
            line = w.key(lo, hi).view(np.int64)
            held[2].append(w.band_keys(lo, hi, bands, rows).ravel())
            held[3].append(np.tile(line, bands))
            size += len(doc) + bands * len(lo)
            if size > 1_500_000:
                b = flush()
                size = 0
                if b is not None:
                    yield b
        b = flush()
        if b is not None:
            yield b

    return materialize(docs.select("d", "t").mapInArrow(run, "kind int, bucket int, keys binary, owners binary, several binary"), "passages")


def _joined(table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, owners, several) of all blocks of a bucket."""
    k, o = (np.concatenate([from_planes(b, t) for b in table.column(name).to_pylist()]) for name, t in (("keys", np.uint64), ("owners", np.int64)))
    return k, o, np.frombuffer(b"".join(table.column("several").to_pylist()), bool)


def bit_table(keys: DataFrame) -> tuple[np.ndarray, bool]:
    """``FILTER_BITS`` bits in which those of the values (one long column) are
    set, and whether there are any."""
    at = F.pmod(F.col(keys.columns[0]), F.lit(FILTER_BITS)) + 1
    # the built-in bitmaps count values from 1 in buckets of 32768 bits
    bits = keys.select(at.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m")).collect()
    table = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in bits:
        table[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(bytes(r["m"]), np.uint8)
    return table, bool(bits)


def has_bit(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    p = keys % FILTER_BITS
    return np.flatnonzero((table[p // 8] >> (p % 8).astype(np.uint8)) & 1)


def index_edges(docs: DataFrame, repeated: DataFrame, buckets: int) -> DataFrame:
    """Blocks as ``index`` writes them (kind 0, 2), of the windows that reach
    out of the repeated units. What the bit table lets through by chance adds
    windows and changes no result."""
    import pyarrow as pa

    names, types = ["kind", "bucket", "keys", "owners", "several"], (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    table, wanted = bit_table(repeated.select("key"))
    shared = docs.sparkSession.sparkContext.broadcast(table)  # FILTER_BITS bits

    @lean
    def run(batches):
        keys, owners, size = [], [], 0

        def flush():
            rows = entry_blocks(0, keys, owners, buckets)
            keys.clear()
            owners.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        t = shared.value
        for ids, texts in text_rows(batches, ("d", "t")):
            if not wanted:
                continue
            w = Words(texts)
            _, lo, hi = w.units()
            hit = has_bit(t, w.key(lo, hi).view(np.int64))
            if not len(hit):
                continue
            doc, at = w.edges(lo[hit], hi[hit])
            keys.append(w.key(at, at + SPAN))
            owners.append(np.array(ids, np.int64)[doc])
            size += len(at)
            if size > 1_500_000:
                yield flush()
                size = 0
        if size:
            yield flush()

    return materialize(docs.select("d", "t").mapInArrow(run, "kind int, bucket int, keys binary, owners binary, several binary"), "edge-windows")


def repeated_passages(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, d, keeper): documents whose unit ``key`` other documents have
    too; keeper is the smallest of them. Also the part of it that was sent,
    which has every such key."""
    import pyarrow as pa

    @lean_group
    def run(table):
        k, o, s = _joined(table)
        order = np.lexsort((o, k))
        k, o, s = k[order], o[order], s[order]
        first = np.r_[True, k[1:] != k[:-1]]
        starts = np.flatnonzero(first)
        counts = np.diff(np.r_[starts, len(k)])
        least = o[starts]
        most = np.maximum.reduceat(o, starts)
        hit = (least != most) | np.logical_or.reduceat(s, starts)
        keep = np.repeat(hit, counts)
        keeper = np.repeat(least, counts)
        return pa.Table.from_arrays([pa.array(k[keep].view(np.int64)), pa.array(o[keep]), pa.array(keeper[keep])], names=["key", "d", "keeper"])

    @lean
    def rows(batches):
        for keys, owners in text_rows(batches, ("keys", "owners"), 1):
            yield pa.RecordBatch.from_arrays([pa.array(from_planes(keys[0], np.int64)), pa.array(from_planes(owners[0], np.int64))], names=["key", "d"])

    sent = materialize(blocks.where("kind = 0").select("bucket", "keys", "owners", "several").groupBy("bucket").applyInArrow(run, "key long, d long, keeper long"), "repeated")
    waiting = blocks.where("kind = 2").select("keys", "owners").mapInArrow(rows, "key long, d long")
    keepers = sent.groupBy("key").agg(F.min("keeper").alias("keeper"))
    return sent.unionByName(waiting.join(keepers, "key")), sent


def similar_paragraphs(docs: DataFrame, blocks: DataFrame, threshold: float) -> DataFrame:
    """(key, d, keeper) of lines that are near copies of others: key is the
    hash of the line's words."""
    import pyarrow as pa

    def pairs_of(k, o):
        """Each owner of a key with the key's smallest one and with the one
        before it."""
        same = k[1:] == k[:-1] if len(k) else np.empty(0, bool)
        a, b = o[1:][same], o[:-1][same]
        starts = np.flatnonzero(np.r_[True, ~same]) if len(k) else np.empty(0, np.int64)
        lead = np.repeat(o[starts], np.diff(np.r_[starts, len(k)]))
        p = np.unique(np.stack([np.r_[a, o], np.r_[b, lead]], 1), axis=0)
        return p[p[:, 0] != p[:, 1]]

    @lean_group
    def run(table):
        """Pairs (key null), the smallest owner b of each key with whom a
        task's other owners pair (a null), and the owners a of each key that
        may have three or more (b null)."""
        k, o, s = _joined(table)
        several = np.unique(k[s])
        order = np.lexsort((o, k))
        k, o = k[order], o[order]
        new = np.r_[True, (k[1:] != k[:-1]) | (o[1:] != o[:-1])]
        k, o = k[new], o[new]
        p = pairs_of(k, o)
        starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        counts = np.diff(np.r_[starts, len(k)])
        rich = np.repeat((counts > 2) | np.isin(k[starts], several), counts)
        key = pa.concat_arrays([pa.nulls(len(p), pa.int64()), pa.array(several.view(np.int64)), pa.array(k[rich].view(np.int64))])
        a = pa.concat_arrays([pa.array(p[:, 0]), pa.nulls(len(several), pa.int64()), pa.array(o[rich])])
        b = pa.concat_arrays([pa.array(p[:, 1]), pa.array(o[np.searchsorted(k, several)]), pa.nulls(int(rich.sum()), pa.int64())])
        return pa.Table.from_arrays([key, a, b], names=["key", "a", "b"])

    @lean
    def rows(batches):
        for keys, owners in text_rows(batches, ("keys", "owners"), 1):
            yield pa.RecordBatch.from_arrays([pa.array(from_planes(keys[0], np.int64)), pa.array(from_planes(owners[0], np.int64))], names=["key", "a"])

    sent = blocks.where("kind = 1").select("bucket", "keys", "owners", "several").groupBy("bucket").applyInArrow(run, "key long, a long, b long")
    sent = materialize(sent, "line-collisions")
    waiting = blocks.where("kind = 3").select("keys", "owners").mapInArrow(rows, "key long, a long")
    members = sent.where("b is null").select("key", F.col("a").alias("line")).unionByName(waiting.select("key", F.col("a").alias("line"))).distinct()
    waiting = waiting.join(sent.where("a is null").select("key", "b"), "key").select("a", "b")
    pairs = materialize(sent.where("key is null").select("a", "b").unionByName(waiting).where("a <> b").distinct(), "line-pairs")

    table, wanted = bit_table(pairs.select(F.explode(F.array("a", "b")).alias("line")).distinct())
    shared = docs.sparkSession.sparkContext.broadcast(table)  # FILTER_BITS bits

    @lean
    def fetch(batches):
        t, sent = shared.value, set()
        for ids, texts in text_rows(batches, ("d", "t")):
            if not wanted:
                continue
            w = Words(texts)
            doc, lo, hi = w.paragraphs()
            line = w.key(lo, hi).view(np.int64)
            hit = has_bit(t, line)
            if not len(hit):
                continue
            s = w.shingles()
            sets = []
            for k in hit.tolist():
                new = int(line[k]) not in sent
                sets.append(_blob(np.unique(s[lo[k] : hi[k] - SHINGLE + 1])) if new else None)
                sent.add(int(line[k]))
            d = np.array(ids, np.int64)[doc[hit]]
            yield pa.RecordBatch.from_arrays([pa.array(line[hit]), pa.array(d), pa.array(sets, pa.binary())], names=["line", "d", "tokens"])

    found = materialize(docs.select("d", "t").mapInArrow(fetch, "line long, d long, tokens binary"), "lines")
    sets = found.where(F.col("tokens").isNotNull()).groupBy("line").agg(F.first("tokens").alias("tokens"))

    @lean
    def verify(batches):
        for a, ta, b, tb in text_rows(batches, ("a", "ta", "b", "tb"), 1024):
            keep = []
            for k, (x, y) in enumerate(zip(ta, tb)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                o = len(np.intersect1d(x, y, assume_unique=True))
                if o >= threshold * (len(x) + len(y) - o):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in keep], pa.int64()), pa.array([b[k] for k in keep], pa.int64())], names=["a", "b"])

    with_sets = pairs.join(sets.select(F.col("line").alias("a"), F.col("tokens").alias("ta")), "a").join(sets.select(F.col("line").alias("b"), F.col("tokens").alias("tb")), "b")
    comp = connected_components(with_sets.select("a", "ta", "b", "tb").mapInArrow(verify, "a long, b long"))
    more = materialize(links_across(members, comp, sets, threshold), "line-links")
    if not more.isEmpty():
        comp = connected_components(comp.select(F.col("vertex").alias("a"), F.col("component").alias("b")).unionByName(more))
    members = found.select("line", "d").distinct().join(comp, F.col("line") == F.col("vertex"))
    keepers = members.groupBy(F.col("component").alias("c")).agg(F.min("d").alias("keeper"))
    return members.join(keepers, F.col("component") == F.col("c")).select(F.col("line").alias("key"), "d", "keeper")


def cross_links(left: list, right: list, threshold: float) -> list[tuple[int, int]]:
    """(line, line) of linked members (line, component, set) of ``left`` and
    ``right`` in different components, one for each right line and left
    component. Overlaps are counted through inverted lists."""
    sizes = np.array([len(s) for _, _, s in left])
    comps = np.array([c for _, c, _ in left])
    tokens, owner = np.concatenate([s for _, _, s in left]), np.repeat(np.arange(len(left)), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    out = []
    for line, c, s in right:
        lo, n = np.searchsorted(tokens, s), np.searchsorted(tokens, s, side="right")
        n = n - lo
        ends = np.cumsum(n)
        idx = np.repeat(lo - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        o = np.bincount(owner[idx], minlength=len(left))
        hit = np.flatnonzero((comps != c) & (o >= threshold * (sizes + len(s) - o)))
        out += [(line, left[k][0]) for k in hit[np.unique(comps[hit], return_index=True)[1]].tolist()]
    return out


def forest(links, comp: dict) -> list[tuple[int, int]]:
    """Those links (line, line) that join components (``comp`` of each line)
    not yet joined by earlier ones: fewer than there are components."""
    up: dict = {}

    def root(c):
        while (p := up.get(c, c)) != c:
            up[c] = c = up.get(p, p)
        return c

    out = []
    for a, b in links:
        x, y = root(comp[a]), root(comp[b])
        if x != y:
            up[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def links_across(members: DataFrame, comp: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links between members (key, line) of a band key that are in
    different components. One of two such members is outside the key's largest
    component, so blocks of those meet blocks of all members. Of the keys with
    the same lines one is looked at."""
    import pyarrow as pa

    tagged = members.join(comp, F.col("line") == F.col("vertex"), "left").select("key", "line", F.coalesce("component", "line").alias("c"))
    tagged = materialize(tagged, "line-members")
    lines = [F.bit_xor(F.xxhash64(F.lit(i), "line")).alias(f"h{i}") for i in (0, 1)]
    sizes = tagged.groupBy("key", "c").agg(F.count(F.lit(1)).alias("n"), *lines)
    sizes = sizes.groupBy("key").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("c", F.struct("n", "c")).alias("main"), *[F.bit_xor(h).alias(h) for h in ("h0", "h1")])
    sizes = sizes.where("n > most").groupBy("n", "most", "main", "h0", "h1").agg(F.min("key").alias("key"))
    sizes = sizes.select("key", "main", F.ceil(F.col("n") / BLOCK).cast("int").alias("all"), F.ceil((F.col("n") - F.col("most")) / BLOCK).cast("int").alias("outside"))
    placed = tagged.join(sizes, "key")
    own = lambda parts: F.pmod(F.xxhash64("line"), F.col(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    left = placed.select("key", own("all").alias("i"), each("outside").alias("j"), "line", "c", F.lit(False).alias("out"))
    right = placed.where("c <> main").select("key", each("all").alias("i"), own("outside").alias("j"), "line", "c", F.lit(True).alias("out"))
    placed = left.unionByName(right).join(sets, "line")

    @lean_group
    def run(table):
        groups: dict = {}
        comp_of = {}
        for key, i, j, line, c, out, t in zip(*(table.column(x).to_pylist() for x in ("key", "i", "j", "line", "c", "out", "tokens"))):
            groups.setdefault((key, i, j), ([], []))[out].append((line, c, np.frombuffer(t, np.uint64)))
            comp_of[line] = c
        found = forest((x for left, right in groups.values() if left and right for x in cross_links(left, right, threshold)), comp_of)
        return pa.Table.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    buckets = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4
    return placed.groupBy(F.pmod(F.xxhash64("key", "i", "j"), F.lit(buckets)).alias("bucket")).applyInArrow(run, "a long, b long")


# ----------------------------------------------------------------- decisions
def removals(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(d, keys, keepers): for each document the hashes of its units that go,
    with the documents that keep them. ``docs`` has d and t (bytes)."""
    bands, rows = tune_bands(threshold)
    spark = docs.sparkSession
    n = docs.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    # about a unit each 40 bytes, and the bands of a line each 200
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(n * (1 / 40 + bands / 200) / BUCKET_ENTRIES) + 1)
    blocks = index(docs, buckets, bands, rows)
    repeated, sent = repeated_passages(blocks)
    beside, _ = repeated_passages(index_edges(docs, sent, buckets))
    gone = repeated.unionByName(beside).unionByName(similar_paragraphs(docs, blocks, threshold)).where("d <> keeper")
    # the units of one document, for each the smallest keeper last
    each = F.sort_array(F.collect_set(F.struct("key", "keeper")), asc=False)
    return gone.groupBy("d").agg(each.alias("g")).select("d", F.col("g.key").alias("keys"), F.col("g.keeper").alias("keepers"))


def spans(texts: list[bytes], keys: list, keepers: list) -> list[list[tuple[int, int, int, int]]]:
    """(start, end, words, keeper) for each text: the byte runs that go, for
    its units ``keys`` and their ``keepers`` (of several the smallest). A run
    covers whole words and the white space between them."""
    w = Words(texts)
    n = len(w.h)
    out: list[list] = [[] for _ in texts]
    sizes = np.array([len(k) for k in keys])
    own = np.concatenate([np.asarray(k, np.int64) for k in keys]) if len(keys) else np.empty(0, np.int64)
    by = np.concatenate([np.asarray(k, np.int64) for k in keepers]) if len(keys) else own
    if not n or not len(own):
        return out
    distinct, rank = np.unique(own, return_inverse=True)
    known = np.repeat(np.arange(len(texts)), sizes) * len(distinct) + rank  # (text, key) as one number
    order = np.lexsort((by, known))
    known, by = known[order], by[order]
    first = np.r_[True, known[1:] != known[:-1]]
    known, by = known[first], by[first]
    bits = max(16, min(24, int(len(distinct)).bit_length() + 4))
    flags = np.zeros(1 << bits, bool)  # most units have no key in any text
    flags[distinct & ((1 << bits) - 1)] = True

    at = np.arange(max(n - SPAN + 1, 0))
    doc = np.searchsorted(w.docs, at, side="right") - 1
    inner = at + SPAN <= w.docs[doc + 1]
    los, his, froms = [], [], []
    for doc, lo, hi in (w.units(alone=True), w.paragraphs(), (doc[inner], at[inner], at[inner] + SPAN)):
        key = w.key(lo, hi).view(np.int64)
        some = np.flatnonzero(flags[key & ((1 << bits) - 1)])
        k = np.minimum(np.searchsorted(distinct, key[some]), len(distinct) - 1)
        ok = distinct[k] == key[some]
        some, pair = some[ok], doc[some[ok]] * len(distinct) + k[ok]
        k = np.minimum(np.searchsorted(known, pair), len(known) - 1)
        ok = known[k] == pair
        los.append(lo[some[ok]])
        his.append(hi[some[ok]])
        froms.append(by[k[ok]])
    lo, hi, keeper = (np.concatenate(v) for v in (los, his, froms))
    if not len(lo):
        return out
    # runs end where a text ends
    inside, edge = covered(lo, hi, n), np.zeros(n + 1, bool)
    edge[w.docs] = True
    a = np.flatnonzero(inside & (edge[:-1] | ~np.r_[False, inside[:-1]]))
    b = np.flatnonzero(inside & (edge[1:] | ~np.r_[inside[1:], False])) + 1
    least = np.full(len(a), NO_ID)
    np.minimum.at(least, np.searchsorted(a, lo, side="right") - 1, keeper)
    long = b - a >= LEAST_WORDS
    a, b, least = a[long], b[long], least[long]
    doc = np.searchsorted(w.docs, a, side="right") - 1
    for k in np.unique(doc).tolist():
        starts, ends = word_bounds(texts[k])
        mine = doc == k
        i, j = a[mine] - w.docs[k], b[mine] - w.docs[k]
        out[k] = list(zip(starts[i].tolist(), ends[j - 1].tolist(), (j - i).tolist(), least[mine].tolist()))
    return out


def word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The first bytes of the words of a text, and the bytes behind them."""
    c = np.frombuffer(text, np.uint8)
    word = np.r_[False, (c != 0x20) & ((c < 0x09) | (c > 0x0D)), False]
    return np.flatnonzero(word[1:] & ~word[:-1]), np.flatnonzero(word[:-1] & ~word[1:])


def _narrow(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("d"), F.col(text).cast("string").cast("binary").alias("t"))


def touched(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose d ``found`` has, and by chance a few others."""
    table, _ = bit_table(found.select("d"))
    shared = docs.sparkSession.sparkContext.broadcast(table)  # FILTER_BITS bits

    @lean
    def run(batches):
        for b in batches:
            yield b.take(has_bit(shared.value, b.column(b.schema.get_field_index("d")).to_numpy()))

    return docs.mapInArrow(run, docs.schema)


def removed_passages(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per run of words that goes: doc_id, start_byte, end_byte (of
    the UTF-8 text), n_words, passage (its text), kept_doc_id (a document that
    keeps words of it).

    Null and empty texts have no units. Rows without an id are one document
    that comes last (doc_id null); rows that share an id keep or lose the
    same units."""
    import pyarrow as pa

    narrow = _narrow(docs, id_col, text)

    @lean
    def run(batches):
        for ids, texts, keys, keepers in text_rows(batches, ("d", "t", "keys", "keepers"), 256):
            rows = []
            for d, t, runs in zip(ids, texts, spans(texts, keys, keepers)):
                rows += [(None if d == NO_ID else d, a, b, n, t[a:b].decode("utf-8", "replace"), None if by == NO_ID else by) for a, b, n, by in runs]
            cols = list(zip(*rows)) or [[]] * 6
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, types)], names=["doc_id", "start_byte", "end_byte", "n_words", "passage", "kept_doc_id"])

    gone = materialize(removals(narrow, threshold), "removals")
    # only texts that lose words are shuffled
    joined = touched(narrow.where(F.col("t").isNotNull()), gone).join(gone, "d")
    return joined.mapInArrow(run, "doc_id long, start_byte long, end_byte long, n_words long, passage string, kept_doc_id long")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars", threshold: float = THRESHOLD) -> DataFrame:
    """The documents with repeated passages cut out of ``text`` (and
    ``n_chars`` counted anew), all other columns as they came. A document of
    which no word is left goes; null and blank texts stay."""
    names = fresh(docs, ["d", "keys", "keepers"])
    gone = removals(_narrow(docs, id_col, text), threshold).withColumnsRenamed({k: names[k] for k in ("d", "keys", "keepers")})

    @F.pandas_udf("string")
    def cut(texts, keys, keepers):
        import pandas as pd

        out = list(texts)
        some = [k for k, t in enumerate(out) if t is not None and keys[k] is not None]
        for lo in range(0, len(some), 256):
            part = some[lo : lo + 256]
            raws = [out[k].encode("utf-8") for k in part]
            for k, raw, runs in zip(part, raws, spans(raws, [keys[k] for k in part], [keepers[k] for k in part])):
                at, parts = 0, []
                for a, b, _, _ in runs:
                    parts.append(raw[at:a])
                    at = b
                left = b"".join([*parts, raw[at:]]) if runs else raw
                out[k] = left.decode("utf-8", "replace") if left.split() or not runs else None
        return pd.Series(out, dtype="object")

    joined = docs.withColumn(names["d"], F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))).join(gone, names["d"], "left")
    touched = F.when(F.col(names["keys"]).isNotNull(), F.col(text))  # other texts do not go to Python
    new = F.when(F.col(names["keys"]).isNull(), F.col(text)).otherwise(cut(touched, F.col(names["keys"]), F.col(names["keepers"])))
    out = joined.withColumn(names["d"], F.col(text).isNull()).withColumn(text, new).where(F.col(names["d"]) | F.col(text).isNotNull())
    if n_chars and n_chars.lower() in {c.lower() for c in docs.columns}:
        out = out.withColumn(n_chars, F.when(F.col(names["keys"]).isNull(), F.col(n_chars)).otherwise(F.length(text)).cast(docs.schema[n_chars].dataType))
    return out.select(*docs.columns)
