"""Audit of how the sources of a language differ in their words.

A task takes the texts of its shard as they lie in Arrow buffers, a slice at a
time, and makes one pointer to each word's start. The pointers are sorted by
the words they point to: multikey quicksort with symbols of eight bytes, all
slices of equal prefixes at once. Runs of equal words give the number of
documents and of occurrences in each (language, source) of the slice; Spark
adds these up. No word becomes a Python object.

With the counts, every source gets an integer share of each kept term. Shares
of two sources are compared over blocks of terms as dense arrays, whose sums
leave a task once per pair of sources.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, lean_group, materialize
from .pretokens import ragged

#: A term is kept in a language if this many of its documents have it.
LEAST_DOCS = 30
SCALE, PRIOR = 1_000_000_000, 5
#: Bytes of text whose pointers are sorted at once (a longer text goes alone).
SLICE = 12 << 20
#: Terms of a group that the report gives.
TOP = 50
#: Sources of a language compared in one block, rows of a block's share of
#: terms, cells of the dense array of a step.
BLOCK, SHARE_ROWS, CELLS = 256, 50_000, 1 << 20

COUNTS = "lang string, source string, term string, n bigint, docs bigint"


# ------------------------------------------------------------------ pointers
def _tables() -> tuple[np.ndarray, np.ndarray]:
    byte = np.arange(256, dtype=np.uint8)
    upper = (byte >= ord("A")) & (byte <= ord("Z"))
    letter = upper | ((byte >= ord("a")) & (byte <= ord("z"))) | (byte >= 0x80)
    return letter, np.where(upper, byte + 0x20, byte).astype(np.uint8)


LETTER, LOWER = _tables()


def pointers(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) of every word in ``data``, in order. ``begins`` are the
    places where texts begin; no word reaches across one."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = LETTER[data]
    starts = inside[1:] & ~inside[:-1]  # by position, one past the end included
    ends = inside[:-1] & ~inside[1:]
    cut = begins[(begins > 0) & (begins < len(data))]
    cut = cut[inside[cut] & inside[cut + 1]]
    starts[cut] = ends[cut] = True
    starts = np.flatnonzero(starts)
    return starts, np.flatnonzero(ends) - starts


def sorted_runs(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the pointers by their words' bytes, number of the run of
    equal words at each place of that order)."""
    n = len(starts)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    symbols = np.ndarray((len(data) + 1,), ">u8", padded, strides=(1,))  # the eight bytes from each place on
    order = np.arange(n)
    new = np.zeros(n, bool)  # a run begins here
    new[:1] = True
    at = np.arange(n)  # places of the order whose slices are still open
    depth = 0
    while len(at):
        p = order[at]
        left = sizes[p] - depth
        key = symbols[starts[p] + depth].astype(np.uint64)
        shift = (8 * (8 - np.clip(left, 1, 8))).astype(np.uint64)
        key = np.where(left > 0, (key >> shift) << shift, 0)  # zeros after the word's end
        if depth == 0:
            by = np.argsort(key)
        else:
            by = np.lexsort((key, np.cumsum(new[at])))
        p, key, left = p[by], key[by], left[by]
        order[at] = p
        new[at[1:]] |= key[1:] != key[:-1]
        # words that end within this symbol are told apart by their zeros; where others share a run, it is open still
        run = np.cumsum(new[at])
        open_ = (left >= 8) & (np.bincount(run)[run] > 1)
        at = at[open_]
        depth += 8
    return order, np.cumsum(new) - 1


def slice_counts(data: np.ndarray, begins: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, ...]:
    """(group, start, size, occurrences, documents) of every (word, group) in
    a slice: ``data`` its bytes, ``begins`` where its texts begin, ``group``
    the group of each text. start and size point to one of the words, in
    lower case in ``LOWER[data]``."""
    low = LOWER[data]
    starts, sizes = pointers(data, begins)
    if not len(starts):
        none = np.empty(0, np.int64)
        return none, none, none, none, none
    order, run = sorted_runs(low, starts, sizes)
    doc = np.searchsorted(begins, starts, side="right") - 1
    pair = np.sort(run * len(begins) + doc[order])
    first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
    times = np.diff(np.r_[first, len(pair)])
    run_of, doc_of = np.divmod(pair[first], len(begins))
    groups = int(group.max()) + 1
    key = run_of * groups + group[doc_of]
    by = np.argsort(key, kind="stable")
    key = key[by]
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    some = order[np.flatnonzero(np.r_[True, run[1:] != run[:-1]])]  # a pointer of each run
    word = some[key[cut] // groups]
    return key[cut] % groups, starts[word], sizes[word], np.add.reduceat(times[by], cut), np.diff(np.r_[cut, len(key)])


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term
    in every group; and one row with a null term for each group that occurs,
    with terms or without. Null texts, languages and sources count as ''.
    Other columns do not matter; each row is a document, repeated or not; an
    empty table gives no rows."""
    import pyarrow as pa

    narrow = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for k, c in (("lang", lang), ("source", source))), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("t"))

    @lean
    def run(batches):
        schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
        for held in slices(batches, SLICE):
            b = pa.Table.from_batches(held)
            langs, sources = (b.column(c).combine_chunks().dictionary_encode() for c in ("lang", "source"))
            many = len(sources.dictionary)
            both = langs.indices.to_numpy().astype(np.int64) * many + sources.indices.to_numpy()
            known, group = np.unique(both, return_inverse=True)
            sizes, data = text_bytes(b.column("t"))
            begins = np.cumsum(sizes) - sizes
            of, at, size, n, d = slice_counts(data, begins, group)
            terms = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.py_buffer(LOWER[data][ragged(at, size)]))
            g = pa.array(np.r_[known, known[of]])
            rows = pa.array(np.r_[np.zeros(len(known), np.int64), n]), pa.array(np.r_[np.zeros(len(known), np.int64), d])
            names = [x.dictionary.take(pa.array(i)) for x, i in ((langs, g.to_numpy() // many), (sources, g.to_numpy() % many))]
            out = pa.Table.from_arrays([*names, pa.concat_arrays([pa.nulls(len(known), pa.string()), terms]), *rows], schema=schema)
            yield from out.to_batches(max_chunksize=100_000)

    parts = narrow.mapInArrow(run, COUNTS)
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, all bytes one after another) of a binary Arrow column without
    nulls; its buffer as it is where one chunk holds the column."""
    sizes, data = [], []
    for c in column.chunks:
        wide = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
        sizes.append(np.diff(wide).astype(np.int64))
        if c.buffers()[2] is not None and len(c):
            data.append(np.frombuffer(c.buffers()[2], np.uint8)[wide[0] : wide[-1]])
    data = data[0] if len(data) == 1 else np.concatenate([np.empty(0, np.uint8), *data])
    return np.concatenate([np.empty(0, np.int64), *sizes]), data


def slices(batches, limit: int):
    """Lists of Arrow batches with about ``limit`` bytes of text each."""
    held, size = [], 0
    for b in batches:
        c = b.column(b.schema.get_field_index("t"))
        ends = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1] if len(c) else np.zeros(1, np.int32)
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, int(ends[lo]) + limit - size, side="right")) - 1)
            held.append(b.slice(lo, hi - lo))
            size += int(ends[hi] - ends[lo])
            lo = hi
            if size >= limit or lo < b.num_rows:
                yield held
                held, size = [], 0
    if held:
        yield held


# -------------------------------------------------------------------- shares
def share(n: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * terms)), exactly;
    null without terms."""
    return F.expr(f"1 + (cast({SCALE} as decimal(10,0)) * cast({n} + {PRIOR} as decimal(20,0))) div nullif(cast({total} + {PRIOR} * {terms} as decimal(20,0)), 0)")


def kept_counts(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """The rows of ``term_counts`` whose term ``least_docs`` documents of the
    language have, with the term's count in the language (``lang_n``). A
    document lies in one group, so its documents add up over the sources."""
    w = Window.partitionBy("lang", "term")  # a row a source
    told = counts.where("term IS NOT NULL").withColumn("_d", F.sum("docs").over(w)).withColumn("lang_n", F.sum("n").over(w))
    return told.where(F.col("_d") >= least_docs).drop("_d", "docs")


def groups_of(counts: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, total, lang_total, terms, sid): each group with its
    occurrences of kept terms, its language's, the number of kept terms of the
    language, and its number among the language's sources (from 0)."""
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    terms = kept.groupBy("lang", "term").agg(F.max("lang_n").alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("lang_total"))
    all_groups = counts.where("term IS NULL").select("lang", "source")
    out = all_groups.join(totals, ["lang", "source"], "left").join(terms, "lang", "left").na.fill(0, ["total", "terms", "lang_total"])
    return out.withColumn("sid", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)


def pair_sums(kept: DataFrame, groups: DataFrame, salts: int, block: int = BLOCK) -> DataFrame:
    """(lang, a, b, more) with a < b: the sum over the terms that source a or
    b has of |p_a - p_b|, less what two absent terms would give.

    Sources lie in blocks, and a row meets every block of its language. Terms
    are dealt into ``salts`` shares, so a group is a share of the terms of two
    blocks; it gives one sum for each pair of its sources."""
    import pyarrow as pa

    base = groups.where("terms > 0").select("lang", "source", "sid", "total", "terms", share("0", "total", "terms").alias("base"))
    last = groups.groupBy("lang").agg((F.max("sid") / F.lit(block)).cast("int").alias("last"))
    salt = F.pmod(F.xxhash64("term"), F.lit(salts)).cast("int")
    rows = kept.join(base, ["lang", "source"]).select("lang", "sid", salt.alias("salt"), "term", share("n", "total", "terms").alias("p"))
    absent = base.select("lang", "sid", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(None).cast("string").alias("term"), F.col("base").alias("p"))
    own = (F.col("sid") / F.lit(block)).cast("int")
    met = rows.unionByName(absent).join(last, "lang").withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("last"))))
    met = met.select("lang", F.least(own, "_x").alias("i"), F.greatest(own, "_x").alias("j"), "salt", "term", "sid", "p")

    @lean_group
    def sums(t):
        sid, p = t.column("sid").to_numpy(), t.column("p").to_numpy()
        term = t.column("term").combine_chunks().dictionary_encode()
        at_base = term.indices.is_null().to_numpy(zero_copy_only=False)
        by = np.argsort(sid[at_base])
        ids, base = sid[at_base][by], p[at_base][by]
        term = term.indices.drop_null().to_numpy()
        by = np.argsort(term, kind="stable")
        term, where, p = term[by], np.searchsorted(ids, sid[~at_base])[by], p[~at_base][by]
        total = np.zeros((len(ids), len(ids)), np.int64)
        terms = int(term[-1]) + 1 if len(term) else 0
        step = max(1, CELLS // max(1, len(ids)))
        for lo in range(0, terms, step):
            hi = min(lo + step, terms)
            pick = slice(*np.searchsorted(term, [lo, hi]))
            m = np.repeat(base[None, :], hi - lo, 0)
            m[term[pick] - lo, where[pick]] = p[pick]
            for k in range(len(ids) - 1):
                total[k, k + 1 :] += np.abs(m[:, k : k + 1] - m[:, k + 1 :]).sum(0) - (hi - lo) * np.abs(base[k] - base[k + 1 :])
        a, b = np.triu_indices(len(ids), 1)
        if t.column("i")[0] != t.column("j")[0]:  # pairs within a block belong to (i, i)
            across = ids[a] // block != ids[b] // block
            a, b = a[across], b[across]
        lang = pa.array([t.column("lang")[0].as_py()] * len(a), pa.string())
        return pa.table({"lang": lang, "a": pa.array(ids[a], pa.int32()), "b": pa.array(ids[b], pa.int32()), "more": pa.array(total[a, b], pa.int64())})

    parts = met.groupBy("lang", "i", "j", "salt").applyInArrow(sums, "lang string, a int, b int, more long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("more").alias("more"))


def pairs(kept: DataFrame, groups: DataFrame, salts: int, block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value): every source of the language but the
    group's own, with the summed differences of the shares of kept terms."""
    side = lambda k: groups.select("lang", F.col("source").alias(f"source_{k}"), F.col("sid").alias(k), F.col("terms").alias(f"terms_{k}"), share("0", "total", "terms").alias(f"base_{k}"))
    both = side("a").join(side("b"), "lang").where("a < b").drop("terms_b")
    value = F.coalesce(F.col("terms_a") * F.abs(F.col("base_a") - F.col("base_b")) + F.coalesce("more", F.lit(0)), F.lit(0))
    both = both.join(pair_sums(kept, groups, salts, block), ["lang", "a", "b"], "left").withColumn("value", F.when(F.col("terms_a") > 0, value).otherwise(0).cast("long"))
    ways = F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item"))))
    return both.select("lang", ways.alias("w"), "value").select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value")


def marked_terms(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, part, item, value): the kept terms of a group with a
    larger share there than in its language, and by how much."""
    rows = kept.join(groups, ["lang", "source"])
    rows = rows.withColumn("value", (share("n", "total", "terms") - share("lang_n", "lang_total", "terms")).cast("long"))
    return rows.where((F.col("n") > 0) & (F.col("value") > 0)).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP, block: int = BLOCK, share_rows: int = SHARE_ROWS) -> DataFrame:
    """lang, source, part, item, value, rank of every (language, source)
    group: part 'pair' compares it with each other source of the language,
    part 'term' lists its ``top`` terms above the language's share. Ranks go
    by value, descending, then by item.

    Null texts, languages and sources count as ''; a group without any term
    still has its pairs; a language without kept terms has values of 0; an
    empty table gives no rows. Rows repeat as documents of their own, and
    other columns of ``docs`` do not matter."""
    counts = materialize(term_counts(docs, lang, source, text), "term-counts")
    kept = materialize(kept_counts(counts, least_docs), "kept-counts")
    groups = materialize(groups_of(counts, kept), "source-groups")
    salts = max(1, kept.count() // share_rows)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    told = pairs(kept, groups, salts, block).withColumn("rank", rank)
    return told.unionByName(marked_terms(kept, groups).withColumn("rank", rank).where(F.col("rank") <= top))
