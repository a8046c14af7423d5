"""Exact Jaccard join of shingle sets with set-relation skipping.

Sets are the distinct 5-word shingles of the texts, as 64-bit hashes; equal
sets form one class. Two classes link when 100 * |x & y| >= percent * |x | y|.

1. *Order.* Shingles found in many texts come last in the order of a set,
   the others by hash. Any order gives the same links; this one keeps frequent
   passages out of the prefixes.
2. *Index.* Each class enters the lists of the first |x| - ceil(t|x|) + 1
   shingles of its order: linked classes share one of them. Tasks send blocks
   of entries by hash range, each class once.
3. *Lists.* Sorted by set size, the entries that a length or position bound
   rules out are skipped block by block.
4. *Open pairs.* The smallest class of a list is its leader; a class meets
   those that have the same most frequent leader, and the classes of mixed
   lists that the bounds leave. Bitmaps rule most of these pairs out; what
   stays open is a graph of candidates.
5. *Answers.* The sets of a component of that graph meet in one task (large
   ones: in blocks), each set once. Overlaps come from an inverted index, and
   those of a set from the overlaps of a similar set worked out before, by the
   shingles in which the two differ.

Nothing is sampled or capped; the table of frequent shingles is bounded
because any table gives the same links.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, lean, lean_group, materialize, shingle_set, text_rows
from .components import connected_components

PERCENT = 80
#: Frequent shingles that come last in the order (8 bytes each, broadcast).
FREQUENT = 131_072
#: Classes of a group that meet in one task; larger groups go in blocks.
BLOCK = 2048
#: Index entries a reducer handles on average.
BUCKET_ENTRIES = 1_000_000
#: Bits of the broadcast filter that picks the documents whose sets are read again.
FILTER_BITS = 1 << 26
#: Bits of the bitmap that goes with a class: about one for each shingle,
#: between these bounds.
LEAST_BITS, MOST_BITS = 1024, 65_536


# ------------------------------------------------------------------ set side
def class_key(s: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def ordered_prefix(s: np.ndarray, frequent: np.ndarray, place: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The prefix of an ascending set; ``frequent`` ascending with ``place``
    in the order of frequency (rarest first)."""
    m = prefix_length(len(s), percent)
    if not len(frequent):
        return s[:m]
    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
    hot = frequent[at] == s
    if not hot[: min(len(s), m)].any():
        return s[:m]
    cold = s[~hot][:m]
    if len(cold) < m:
        late = s[hot][np.argsort(place[at[hot]], kind="stable")]
        cold = np.concatenate([cold, late[: m - len(cold)]])
    return cold


def linked(overlap, na, nb, percent: int = PERCENT):
    return 100 * overlap >= percent * (na + nb - overlap)


def bitmap(s: np.ndarray) -> np.ndarray:
    """Parities: how many elements of the set fall on each bit, odd or even.
    The width is a power of two that follows the size of the set; halves laid
    on each other (``fold``) give the bitmap of half the width."""
    bits = LEAST_BITS
    while bits < min(len(s), MOST_BITS):
        bits *= 2
    odd = np.bincount((s >> np.uint64(20)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.uint64)


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def may_link(a: np.ndarray, na, b: np.ndarray, nb, percent: int = PERCENT) -> np.ndarray:
    """Whether bitmaps (of equal width) and sizes leave it open that sets
    link: sets differ in at least as many elements as their bitmaps in bits,
    so the overlap is at most (na + nb - differing bits) / 2."""
    differ = np.bitwise_count(a ^ b).sum(axis=-1).astype(np.int64)
    return linked((na + nb - differ) // 2, na, nb, percent)


def by_width(maps: list[bytes]) -> list[tuple[int, int, np.ndarray]]:
    """(from, to, bitmaps) for each stretch of equal width."""
    widths = np.array([len(m) for m in maps])
    cuts = np.flatnonzero(np.r_[True, widths[1:] != widths[:-1], True])
    return [(lo, hi, np.frombuffer(b"".join(maps[lo:hi]), np.uint64).reshape(hi - lo, -1)) for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def group_links(rows: list[np.ndarray], against: list[np.ndarray], same: bool, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Pairs (index in rows, index in against) that connect what links
    connect (a spanning forest). Overlaps of a set with all of ``against``
    are counted through inverted lists, or derived from those of the set
    before: plus the lists of shingles it has more, minus those it lacks."""
    if not rows or not against:
        return []
    sizes = np.array([len(s) for s in against])
    tokens = np.concatenate(against)
    owner = np.repeat(np.arange(len(against)), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    forest = Forest(len(rows) + (0 if same else len(against)))
    out: list[tuple[int, int]] = []
    before, overlap = np.empty(0, np.uint64), np.zeros(len(against), np.int64)

    def add(part: np.ndarray, sign: int) -> np.ndarray:
        lo, hi = np.searchsorted(tokens, part), np.searchsorted(tokens, part, side="right")
        n = hi - lo
        ends = np.cumsum(n)
        idx = np.repeat(lo - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        return sign * np.bincount(owner[idx], minlength=len(against))

    for i in sorted(range(len(rows)), key=lambda i: rows[i][:4].tolist()):
        s = rows[i]
        more = np.setdiff1d(s, before, assume_unique=True)
        less = np.setdiff1d(before, s, assume_unique=True)
        if len(more) + len(less) < len(s):
            overlap = overlap + add(more, 1) + add(less, -1)
        else:
            overlap = add(s, 1)
        before = s
        for j in np.flatnonzero(linked(overlap, len(s), sizes, percent)).tolist():
            if same and i == j:
                continue
            if forest.join(i, j if same else len(rows) + j):
                out.append((i, j))
    return out


def open_entries(tok: np.ndarray, n: np.ndarray, p: np.ndarray, percent: int, near: int = 8) -> np.ndarray:
    """The entries (lists one after another, each by size) that may link with
    another of their list by length and position. The ``near`` next entries
    by size are tried; in lists longer than that, entries whose neighbour by
    size is near enough stay."""
    keep = np.zeros(len(tok), bool)
    for d in range(1, near + 1):
        if len(tok) <= d:
            break
        same = tok[d:] == tok[:-d]
        ok = same & linked(np.minimum(n[d:] - p[d:], n[:-d] - p[:-d]), n[d:], n[:-d], percent)
        keep[d:] |= ok
        keep[:-d] |= ok
    if len(tok) > near:
        starts = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]])
        counts = np.diff(np.r_[starts, len(tok)])
        close = (tok[1:] == tok[:-1]) & (100 * n[:-1] >= percent * n[1:])
        keep |= np.repeat(counts > near + 1, counts) & (np.r_[close, False] | np.r_[False, close])
    return keep


# ----------------------------------------------------------------- Spark side
def _blob(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def _joined(table, name: str, t) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), t)


def documents_with_class(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """A written table of (doc_id, n, k, bits) rows, and rows with ``tokens``
    and ``counts``: shingles that occur in at least four classes of a task's
    share."""
    import pyarrow as pa

    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("k", pa.int64()), ("bits", pa.binary()), ("tokens", pa.binary()), ("counts", pa.binary())])

    @lean
    def run(batches):
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def frequent():
            u, c = np.unique(np.concatenate([*held, np.empty(0, np.uint64)]), return_counts=True)
            u, c = u[c >= 4], c[c >= 4]
            if len(u) > FREQUENT:
                keep = np.sort(np.lexsort((u, -c))[:FREQUENT])
                u, c = u[keep], c[keep]
            return {"doc_id": None, "n": None, "k": None, "bits": None, "tokens": _blob(u), "counts": _blob(c.astype(np.int64))}

        for ids, texts in text_rows(batches, ("doc_id", "t")):
            ns, ks, maps = [], [], []
            for t in texts:
                s = shingle_set(t)
                ns.append(len(s))
                ks.append(class_key(s))
                maps.append(_blob(bitmap(s)))
                if len(s) and ks[-1] not in seen:
                    seen.add(ks[-1])
                    held.append(s)
                    size += len(s)
            none = pa.nulls(len(ids), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int32()), pa.array(ks, pa.int64()), pa.array(maps), none, none], schema=schema)
            if size > 3_000_000:
                yield pa.RecordBatch.from_pylist([frequent()], schema=schema)
                held, size = [], 0
                seen.clear()
        if size:
            yield pa.RecordBatch.from_pylist([frequent()], schema=schema)

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("t"))
    return materialize(narrow.mapInArrow(run, "doc_id long, n int, k long, bits binary, tokens binary, counts binary"), "classes")


def frequent_shingles(table: DataFrame, size: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """(ascending shingles, their place in the order of frequency)."""
    import pyarrow as pa

    @lean
    def run(batches):
        for tokens, counts in text_rows(batches, ("tokens", "counts"), 1):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(tokens[0], np.int64)), pa.array(np.frombuffer(counts[0], np.int64))], names=["token", "c"])

    each = table.where(F.col("tokens").isNotNull()).select("tokens", "counts").mapInArrow(run, "token long, c long")
    top = each.groupBy("token").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "token").limit(size).toPandas()
    tokens = top["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], np.arange(len(tokens))[::-1][order]  # rarest first


def index_entries(docs: DataFrame, text: str, frequent: tuple[np.ndarray, np.ndarray], buckets: int, percent: int) -> DataFrame:
    """(token, k, n, pos, leader): the entries of lists with at least two
    classes of which one may link by size."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(frequent)  # at most FREQUENT shingles
    names = ["bucket", "tokens", "ks", "ns", "ps"]

    @lean
    def run(batches):
        hot, place = shared.value
        seen: set[int] = set()
        parts: list = []
        size = 0

        def flush():
            tok = np.concatenate([p[0] for p in parts])
            lens = [len(p[0]) for p in parts]
            ks = np.repeat(np.array([p[1] for p in parts], np.int64), lens)
            ns = np.repeat(np.array([p[2] for p in parts], np.int32), lens)
            ps = np.concatenate([np.arange(m, dtype=np.int32) for m in lens])
            order = np.argsort(tok)
            tok, ks, ns, ps = tok[order], ks[order], ns[order], ps[order]
            at = ((tok >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            ends = np.searchsorted(at, np.arange(buckets + 1))
            rows = [(b, _blob(tok[lo:hi]), _blob(ks[lo:hi]), _blob(ns[lo:hi]), _blob(ps[lo:hi])) for b, (lo, hi) in enumerate(zip(ends[:-1], ends[1:])) if hi > lo]
            parts.clear()
            types = (pa.int32(), *[pa.binary()] * 4)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for (texts,) in text_rows(batches, ("t",)):
            for t in texts:
                s = shingle_set(t)
                if not len(s):
                    continue
                k = class_key(s)
                if k in seen:
                    continue
                seen.add(k)
                parts.append((ordered_prefix(s, hot, place, percent), k, len(s)))
                size += len(parts[-1][0])
            if size > 1_500_000:
                yield flush()
                size = 0
        if parts:
            yield flush()

    @lean_group
    def gather(table):
        tok, k, n, p = _joined(table, "tokens", np.int64), _joined(table, "ks", np.int64), _joined(table, "ns", np.int32), _joined(table, "ps", np.int32)
        order = np.lexsort((k, n, tok))
        tok, k, n, p = tok[order], k[order], n[order], p[order]
        keep = np.r_[True, (tok[1:] != tok[:-1]) | (k[1:] != k[:-1]) | (n[1:] != n[:-1])]  # a class from several tasks
        tok, k, n, p = tok[keep], k[keep], n[keep], p[keep]
        keep = open_entries(tok, n.astype(np.int64), p.astype(np.int64), percent)
        tok, k, n, p = tok[keep], k[keep], n[keep], p[keep]
        if len(tok):
            starts = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]])
            leader = np.repeat(np.minimum.reduceat(k, starts), np.diff(np.r_[starts, len(tok)]))
        else:
            leader = k
        return pa.Table.from_arrays([pa.array(x) for x in (tok, k, n, p, leader)], names=["token", "k", "n", "pos", "leader"])

    narrow = docs.select(F.col(text).cast("string").cast("binary").alias("t"))
    blocks = narrow.mapInArrow(run, "bucket int, tokens binary, ks binary, ns binary, ps binary")
    return blocks.groupBy("bucket").applyInArrow(gather, "token long, k long, n int, pos int, leader long")


def cross_pairs(entries: DataFrame, buckets: int, percent: int) -> DataFrame:
    """(ka, na, kb, nb): pairs of a list whose groups differ and that length
    and position do not rule out, each once."""
    import pyarrow as pa

    @lean_group
    def run(table):
        cols = [table.column(c).to_numpy() for c in ("token", "n", "k", "pos", "home")]
        order = np.lexsort((cols[2], cols[1], cols[0]))
        tok, n, k, p, home = (c[order] for c in cols)
        n, p = n.astype(np.int64), p.astype(np.int64)
        found = [np.empty((0, 4), np.int64)]
        if len(tok):
            starts = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]])
            ends = np.r_[starts[1:], len(tok)]
            mixed = np.maximum.reduceat(home, starts) != np.minimum.reduceat(home, starts)
            for lo, hi in zip(starts[mixed].tolist(), ends[mixed].tolist()):
                # by size: entry i skips all from the first that is too large
                stop = lo + np.searchsorted(n[lo:hi], 100 * n[lo:hi] // percent, side="right")
                width = stop - np.arange(lo, hi) - 1
                at = 0
                while at < hi - lo:  # some entries at a time, a million pairs at most (or one entry's)
                    upto = max(int(np.searchsorted(np.cumsum(width[at:]), 1_000_000, side="right")) + at, at + 1)
                    w = width[at:upto]
                    i = np.repeat(np.arange(lo + at, lo + upto), w)
                    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(w) - w, w)
                    most = np.minimum(n[i] - p[i], n[j] - p[j])
                    ok = (home[i] != home[j]) & linked(most, n[i], n[j], percent)
                    i, j = i[ok], j[ok]
                    swap = k[i] > k[j]
                    i, j = np.where(swap, j, i), np.where(swap, i, j)
                    found.append(np.stack([k[i], n[i], k[j], n[j]], 1))
                    at = upto
                if sum(map(len, found)) > 4_000_000:
                    found = [np.unique(np.concatenate(found), axis=0)]
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.Table.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1].astype(np.int32)), pa.array(pairs[:, 2]), pa.array(pairs[:, 3].astype(np.int32))], names=["ka", "na", "kb", "nb"])

    bucket = F.pmod(F.xxhash64("token"), F.lit(buckets)).alias("bucket")
    return entries.groupBy(bucket).applyInArrow(run, "ka long, na int, kb long, nb int").distinct()


def read_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text: str) -> DataFrame:
    """(k, n, tokens): the sets of the classes in ``wanted`` (k, n, doc_id),
    read from one document each. A bounded bit table of the document ids is
    broadcast; what it lets through by chance, or twice, does no harm in the
    joins that follow."""
    import pyarrow as pa

    spark = docs.sparkSession
    at = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    # the built-in bitmaps count values from 1 in buckets of 32768 bits
    bits = wanted.select((at + 1).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m")).collect()
    table = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in bits:
        table[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(bytes(r["m"]), np.uint8)
    shared = spark.sparkContext.broadcast(table)  # FILTER_BITS bits

    @lean
    def run(batches):
        t = shared.value
        seen: set[int] = set()
        for b in batches:
            p = b.column(b.schema.get_field_index("p")).to_numpy()
            hit = (t[p // 8] >> (p % 8).astype(np.uint8)) & 1
            part = b.filter(pa.array(hit.astype(bool)))
            for (texts,) in text_rows([part], ("t",), 256):
                sets = {class_key(s): s for s in map(shingle_set, texts) if len(s)}
                new = [(k, len(s), _blob(s)) for k, s in sets.items() if k not in seen]
                seen.update(sets)
                if new:
                    yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*new), (pa.int64(), pa.int32(), pa.binary()))], names=["k", "n", "tokens"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("t")).select(at.alias("p"), "t")
    sets = source.mapInArrow(run, "k long, n int, tokens binary")
    return materialize(sets, "sets")


def open_in_groups(homes: DataFrame, buckets: int, percent: int) -> DataFrame:
    """(ka, na, ia, kb, nb, ib): pairs of members of a group that connect what
    the bitmaps leave open (a spanning forest). Members of groups of more than
    ``BLOCK`` are connected without a look."""
    import pyarrow as pa

    @lean_group
    def run(table):
        cols = [table.column(c).to_numpy() for c in ("k", "n", "home")]
        order = np.lexsort((cols[1], cols[2]))
        k, n, home = (c[order] for c in cols)
        n = n.astype(np.int64)
        maps = table.column("bits").take(pa.array(order)).to_pylist()
        left, right = [], []
        starts = np.flatnonzero(np.r_[True, home[1:] != home[:-1]])
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(k)]):
            if hi - lo > BLOCK:
                left += range(lo, hi - 1)
                right += range(lo + 1, hi)
                continue
            forest = Forest(hi - lo)
            stretches = by_width(maps[lo:hi])  # sorted by size, so by width
            for x, (a, b, own) in enumerate(stretches):
                for i in range(a, b):
                    # by size: what is too large for i ends the block of entries to look at
                    stop = int(np.searchsorted(n[lo:hi], 100 * n[lo + i] // percent, side="right"))
                    for c, d, other in stretches[x:]:
                        c, e = max(c, i + 1), min(d, stop)
                        if c < e:
                            part = fold(other[c - d + len(other) : e - d + len(other)], own.shape[1])
                            for y in (c + np.flatnonzero(may_link(own[i - a], n[lo + i], part, n[lo + c : lo + e], percent))).tolist():
                                if forest.join(i, y):
                                    left.append(lo + i)
                                    right.append(lo + y)
        ids = table.column("doc_id").take(pa.array(order))
        a, b = np.array(left, np.int64), np.array(right, np.int64)
        size = n.astype(np.int32)
        ends = [x for e in (a, b) for x in (pa.array(k[e]), pa.array(size[e]), ids.take(pa.array(e)))]
        return pa.Table.from_arrays(ends, names=["ka", "na", "ia", "kb", "nb", "ib"])

    bucket = F.pmod(F.xxhash64("home"), F.lit(buckets)).alias("bucket")
    several = homes.groupBy("home").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("home")
    joined = homes.join(several, "home").select("k", "n", "home", "doc_id", "bits")
    return joined.groupBy(bucket).applyInArrow(run, "ka long, na int, ia long, kb long, nb int, ib long")


def open_pairs(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs that may link by their bitmaps."""
    import pyarrow as pa

    @lean
    def run(batches):
        for b in batches:
            get = lambda c: b.column(b.schema.get_field_index(c))
            na, nb = (get(c).to_numpy().astype(np.int64) for c in ("na", "nb"))
            ok = np.zeros(b.num_rows, bool)
            pairs = [[np.frombuffer(x, np.uint64) for x in get(c).to_pylist()] for c in ("ba", "bb")]
            width = np.array([min(len(x), len(y)) for x, y in zip(*pairs)], np.int64)
            for w in np.unique(width).tolist():
                at = np.flatnonzero(width == w)
                left, right = (np.stack([fold(side[k], w) for k in at.tolist()]) for side in pairs)
                ok[at] = may_link(left, na[at], right, nb[at], percent)
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([get(c) for c in names], names=names).filter(keep)

    names = ["ka", "na", "ia", "kb", "nb", "ib"]
    a = classes.select(F.col("k").alias("ka"), F.col("n").alias("na"), F.col("doc_id").alias("ia"), F.col("bits").alias("ba"))
    b = classes.select(F.col("k").alias("kb"), F.col("n").alias("nb"), F.col("doc_id").alias("ib"), F.col("bits").alias("bb"))
    return pairs.join(a, ["ka", "na"]).join(b, ["kb", "nb"]).mapInArrow(run, "ka long, na int, ia long, kb long, nb int, ib long")


def links_in_groups(sets: DataFrame, homes: DataFrame, buckets: int, percent: int) -> DataFrame:
    """(a, b): edges that connect the linked classes of each group."""
    import pyarrow as pa

    sizes = homes.groupBy("home").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    placed = homes.join(sizes, "home").join(sets, ["k", "n"])
    parts = F.ceil(F.col("members") / BLOCK).cast("int")
    placed = placed.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("k"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    placed = placed.select("home", "k", "tokens", "own", other)
    placed = placed.select("home", "k", "tokens", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    @lean_group
    def run(table):
        rows: dict = {}
        for home, i, j, own, k, t in zip(*(table.column(c).to_pylist() for c in ("home", "i", "j", "own", "k", "tokens"))):
            rows.setdefault((home, i, j), ([], []))[0 if own == i else 1].append((k, np.frombuffer(t, np.uint64)))
        out = []
        for (_, i, j), (left, right) in rows.items():
            if i == j:
                right = left
            left, right = sorted(left, key=lambda x: x[0]), sorted(right, key=lambda x: x[0])
            out += [(left[a][0], right[b][0]) for a, b in group_links([x[1] for x in left], [x[1] for x in right], i == j, percent)]
        return pa.Table.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

    bucket = F.pmod(F.xxhash64("home", "i", "j"), F.lit(buckets)).alias("bucket")
    return placed.groupBy(bucket).applyInArrow(run, "a long, b long")


def join_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the size of its set
    and the smallest id that links lead to, its own included.

    Null and blank texts have an empty set and link with nothing. Rows with a
    null id take part; their component is the smallest id that is not null,
    or null. Repeated rows are rows of one class. Classes are told apart by a
    64-bit hash and their size."""
    spark = docs.sparkSession
    table = documents_with_class(docs, id_col, text)
    own = table.where(F.col("tokens").isNull()).select("doc_id", "n", "k")
    every = table.where("n > 0").groupBy("k", "n").agg(F.min("doc_id").alias("doc_id"), F.first("bits").alias("bits"))
    classes = materialize(every, "class-ids")
    total = classes.agg(F.sum(F.col("n") * (100 - percent) / 100 + 1)).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total // BUCKET_ENTRIES) + 1)
    entries = materialize(index_entries(docs, text, frequent_shingles(table), buckets, percent), "entries")
    met = entries.groupBy("k", "n", "leader").agg(F.count(F.lit(1)).alias("c"))
    homes = met.groupBy("k", "n").agg(F.max_by("leader", F.struct("c", F.bitwise_not("leader"))).alias("home"))
    homes = materialize(homes, "homes")
    inside = open_in_groups(homes.join(classes, ["k", "n"]), buckets, percent)
    across = open_pairs(cross_pairs(entries.join(homes, ["k", "n"]), buckets, percent), classes, percent)
    still_open = materialize(inside.unionByName(across), "open-pairs")
    together = connected_components(still_open, "ka", "kb").select(F.col("vertex").alias("k"), F.col("component").alias("home"))
    ends = [still_open.select(F.col(f"k{x}").alias("k"), F.col(f"n{x}").alias("n"), F.col(f"i{x}").alias("doc_id")) for x in "ab"]
    members = ends[0].unionByName(ends[1]).distinct()
    sets = read_sets(docs, members, id_col, text)
    comp = connected_components(links_in_groups(sets, members.join(together, "k").select("k", "n", "home"), buckets, percent))
    members = classes.select("k", "n", "doc_id").join(comp, F.col("k") == F.col("vertex"), "left").withColumn("c", F.coalesce("component", "k"))
    least = members.groupBy(F.col("c").alias("c_")).agg(F.min("doc_id").alias("component_id"))
    found = members.join(least, F.col("c") == F.col("c_")).select(F.col("k").alias("k_"), F.col("n").alias("n_"), "component_id")
    out = own.join(found, (F.col("k") == F.col("k_")) & (F.col("n") == F.col("n_")), "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The documents with the smallest id of their component, all columns as
    they came; documents without an id stay."""
    key = fresh(docs, ["first"])["first"]
    first = join_documents(docs, id_col, text, percent).where("doc_id = component_id").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(first, docs[id_col] == first[key], "left_semi").unionByName(docs.where(docs[id_col].isNull()))
