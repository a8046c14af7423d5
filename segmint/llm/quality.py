"""Quality rules with adaptive thresholds (DataFrame functions only).

Text statistics are computed per document. Each statistic is turned into an
integer share (per mille), counted into a mergeable quantile sketch per
(language, source), and the sketch gives the group's own fence. Documents
above a fence of their group are rejected by a join with the fences.

A fence lies where the group's tail ends, judged by its median and an upper
quantile, plus a tolerance. The tail's length is a weighted mean of the
group's own, its language's and the corpus's, by the numbers of documents, so
a small group leans on the wider ones and no size changes the rule.

The sketch is a histogram over the integer shares 0..1000. It is mergeable by
adding counts (so Spark combines it map-side, and a source holding a third of
all rows is summed before the shuffle), bounded (1001 bins a statistic) and
its quantiles are exact at that resolution.

Words are the runs ``[^\\x20\\x09-\\x0D]+``; a null text has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize

WS = "[\\x20\\x09-\\x0D]"
WS_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"

#: statistic -> (numerator, denominator, level, tolerance): the quantile that
#: tells a group's tail, and what a document may lie above it, in per mille.
SHARES: dict[str, tuple[str, str, float, int]] = {
    "symbols": ("n_symbols", "word_chars", 0.90, 20),
    "dup_lines": ("n_dup_lines", "n_lines", 0.95, 250),
    "repeats": ("n_repeat_words", "n_words", 0.95, 100),
}
#: A group's tail reaches to median + TAIL * (quantile - median).
TAIL = 4
#: Documents that the wider group (language, then all) counts for.
PRIOR = 200


def text_statistics(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines (lines with a word),
    n_dup_lines and n_repeat_words (all long) to ``docs``.

    n_repeat_words counts the words that lie in a three-word window found at
    least twice in the text, the first one included. Windows are compared by
    64-bit hashes. A null or blank text gets zeros. ``prefix`` is put before
    the new names, so that clashing columns of the input survive."""
    taken = fresh(docs, ["t", "w", "h", "bi", "tri", "s", "hit"])
    t, w, h, bi, tri, s, hit = (taken[k] for k in ("t", "w", "h", "bi", "tri", "s", "hit"))
    n_words = F.size(w).cast("long")

    def below(col: str, k: int) -> Column:
        return F.greatest(F.size(col) - F.lit(k), F.lit(0))

    out = docs.withColumn(t, F.coalesce(F.col(text).cast("string"), F.lit("")))
    trimmed = F.btrim(F.col(t), F.lit(WS_CHARS))
    out = out.withColumn(w, F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, WS + "+")))
    out = out.withColumn(h, F.transform(w, lambda x: F.xxhash64(x)))
    out = out.withColumn(bi, F.zip_with(F.slice(h, 1, below(h, 1)), F.slice(h, 2, below(h, 1)), lambda a, b: F.xxhash64(a, b)))
    out = out.withColumn(tri, F.zip_with(F.slice(bi, 1, below(bi, 1)), F.slice(h, 3, below(bi, 1)), lambda a, b: F.xxhash64(a, b)))
    repeated = F.size(F.array_distinct(tri)) < F.size(tri)
    out = out.withColumn(s, F.when(repeated, F.sort_array(F.transform(tri, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    same = lambda x, y: F.coalesce(x["x"] == y["x"], F.lit(False))
    out = out.withColumn(hit, F.filter(s, lambda x, i: same(x, F.get(F.col(s), i - 1)) | same(x, F.get(F.col(s), i + 1))))
    covered = F.size(F.array_distinct(F.flatten(F.transform(hit, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    lines = F.filter(F.split(F.col(t), "\n", -1), lambda x: F.length(F.btrim(x, F.lit(WS_CHARS))) > 0)
    out = out.withColumns({
        f"{prefix}n_words": n_words,
        f"{prefix}word_chars": (F.length(t) - F.regexp_count(F.col(t), F.lit(WS))).cast("long"),
        f"{prefix}n_symbols": F.regexp_count(F.col(t), F.lit(SYMBOLS)).cast("long"),
        f"{prefix}n_repeat_words": F.when(F.col(hit).isNull(), F.lit(0)).otherwise(covered).cast("long"),
        taken["t"]: lines,
    })
    return out.withColumns({
        f"{prefix}n_lines": F.size(t).cast("long"),
        f"{prefix}n_dup_lines": (F.size(t) - F.size(F.array_distinct(t))).cast("long"),
    }).drop(*taken.values())


def base_failed(prefix: str = "") -> Column:
    n_words, n_repeat_words = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def shares(stats: DataFrame, prefix: str = "") -> DataFrame:
    """Adds the integer per-mille shares ``pm_<statistic>`` (0 where the
    denominator is 0), all names with ``prefix``."""
    return stats.withColumns({
        f"{prefix}pm_{k}": F.floor(F.col(prefix + num) * 1000 / F.greatest(F.col(prefix + den), F.lit(1))).cast("int") for k, (num, den, _, _) in SHARES.items()
    })


def sketches(stats: DataFrame, keys: list[str]) -> DataFrame:
    """The mergeable sketch: (keys, statistic, share, n). Null keys form a
    group of their own. Pass the rows that the base rules leave: the others
    go in any case and would only widen the tails."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("statistic"), F.col(f"pm_{k}").alias("share")) for k in SHARES]))
    return stats.select(*keys, each.alias("e")).groupBy(*keys, "e.statistic", "e.share").agg(F.count(F.lit(1)).alias("n"))


def quantiles(sketch: DataFrame, keys: list[str], levels: dict[str, Column]) -> DataFrame:
    """Quantiles of each sketch: the least share whose cumulated count
    reaches the level times the group's count ``n``. Sketches of a group are
    arrays of at most 1001 bins."""
    bins = (
        sketch.groupBy(*keys, "statistic", "share").agg(F.sum("n").alias("n"))
        .groupBy(*keys, "statistic").agg(F.sort_array(F.collect_list(F.struct("share", "n"))).alias("bins"), F.sum("n").alias("n"))
    )

    def at(level: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("cum"), F.lit(None).cast("int").alias("q"))
        step = lambda acc, b: F.struct(
            (acc["cum"] + b["n"]).alias("cum"),
            F.when(acc["q"].isNotNull(), acc["q"]).when((acc["cum"] + b["n"]) >= level * F.col("n"), b["share"]).alias("q"),
        )
        return F.aggregate("bins", start, step)["q"]

    return bins.select(*keys, "statistic", "n", *[at(q).alias(name) for name, q in levels.items()])


def tails(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, statistic, n, tail): where the tail of each sketch ends."""
    level = F.create_map(*[x for k, v in SHARES.items() for x in (F.lit(k), F.lit(v[2]))])
    q = quantiles(sketch, keys, {"mid": F.lit(0.5), "high": level[F.col("statistic")]})
    return q.select(*keys, "statistic", "n", (F.col("mid") + TAIL * (F.col("high") - F.col("mid"))).cast("long").alias("tail"))


def fences(sketch: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, fence_<statistic>...): one row a group. Sketches of a
    language and of all documents are the sums of their groups' sketches."""
    own = tails(sketch, [lang, source])
    by_lang = tails(sketch, [lang]).select(F.col(lang).alias("l_"), F.col("statistic").alias("s_"), F.col("n").alias("n_lang"), F.col("tail").alias("tail_lang"))
    everywhere = tails(sketch, []).select(F.col("statistic").alias("t_"), F.col("tail").alias("tail_all"))
    wide = by_lang.join(everywhere, F.col("s_") == F.col("t_")).withColumn("wide", F.expr(f"(n_lang * tail_lang + {PRIOR} * tail_all) div (n_lang + {PRIOR})"))
    both = own.join(wide, F.col(lang).eqNullSafe(F.col("l_")) & (F.col("statistic") == F.col("s_")))
    tolerance = F.create_map(*[x for k, v in SHARES.items() for x in (F.lit(k), F.lit(v[3]))])
    fence = F.expr(f"(n * tail + {PRIOR} * wide) div (n + {PRIOR})") + tolerance[F.col("statistic")]
    return both.groupBy(lang, source).agg(*[F.max(F.when(F.col("statistic") == k, fence)).alias(f"fence_{k}") for k in SHARES])


def report(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source and the fences of every group of ``docs``, in per mille."""
    narrow = docs.select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))
    stats = materialize(shares(text_statistics(narrow).drop("text")), "quality-stats")
    return fences(sketches(stats.where(~base_failed()), ["lang", "source"]))


def judge(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per input row: doc_id, the statistics, base_failed, kept, and
    ``reasons`` (the statistics over the group's fence).

    Null languages and sources are groups of their own. Null ids are kept as
    rows; repeated rows are judged each for themselves. Texts enter one scan:
    the narrow statistics are written to the shared folder, and both the
    sketches and the join read that table."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))
    stats = materialize(shares(text_statistics(narrow).drop("text")), "quality-stats")
    limits = fences(sketches(stats.where(~base_failed()), ["lang", "source"])).withColumnsRenamed({"lang": "l_", "source": "s_"})
    out = stats.join(limits, stats["lang"].eqNullSafe(F.col("l_")) & stats["source"].eqNullSafe(F.col("s_")), "left")
    over = F.filter(F.array(*[F.when(F.col(f"pm_{k}") > F.col(f"fence_{k}"), F.lit(k)) for k in SHARES]), lambda x: x.isNotNull())
    out = out.withColumn("base_failed", base_failed()).withColumn("reasons", F.array_join(over, ","))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("reasons") == "")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "reasons"
    )


def filter_documents(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows that the rules keep, all columns as they came. Every row is
    judged for itself, whatever its id. The rows are written to the shared
    folder with their statistics; only the fences are joined to them."""
    p = "_q_"
    while any(c.lower().startswith(p) for c in docs.columns):
        p = "_" + p
    rows = materialize(shares(text_statistics(docs, text, p), p), "quality-rows")
    stats = rows.where(~base_failed(p)).select(F.col(lang).alias("lang"), F.col(source).alias("source"), *[F.col(f"{p}pm_{k}").alias(f"pm_{k}") for k in SHARES])
    limits = fences(sketches(stats, ["lang", "source"])).withColumnsRenamed({c: p + c for c in ("lang", "source", *(f"fence_{k}" for k in SHARES))})
    limits = materialize(limits, "quality-fences")
    out = rows.join(limits, F.col(lang).eqNullSafe(F.col(f"{p}lang")) & F.col(source).eqNullSafe(F.col(f"{p}source")), "left")
    kept = ~base_failed(p)
    for k in SHARES:
        kept = kept & ~F.coalesce(F.col(f"{p}pm_{k}") > F.col(f"{p}fence_{k}"), F.lit(False))
    return out.where(kept).drop(*[c for c in out.columns if c.startswith(p)])
