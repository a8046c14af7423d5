"""File sources and sinks: customer CSV scan, literal rows, CSV sinks and
the active-table choice.

CSV follows RFC 4180: fields may be quoted, a quoted field may hold commas,
line breaks and doubled quotes. A file is read by many tasks all the same: the
parity of quotes in each byte range tells where records begin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import _NUMERIC_TEXT
from ..functions.constants import MIN_ROWS, NA_TEXTS

MALFORMED = "_malformed"
_RFC4180 = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true"}


class TableError(ValueError):
    """A table that cannot be used; ``code`` says why: no_columns, no_rows,
    too_few_rows, malformed_lines."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


def _names(spark: SparkSession, path: str) -> list[str]:
    return spark.read.options(**_RFC4180).csv(path).columns


def _records(spark: SparkSession, path: str) -> DataFrame:
    """(seq, file, first, text): the records of the CSV files at ``path``, one
    or more lines each, read by as many tasks as there are byte ranges.
    ``seq`` grows by file path, then along the file; ``first`` marks the first
    record of a file.

    A line break lies inside a quoted field where an odd number of quotes
    comes before it in the file. Every byte range tells the parity of its
    quotes and how many records begin in it for either state that it may start
    in; a running sum over these rows, one a range, gives the true states, and
    with them the ranges are cut into records independently. Lines that are
    not a whole record meet by record."""
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(
        F.col("value"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row")
    )  # rows of a range are in order: one task reads it
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    along = Window.partitionBy("_file", "_block").orderBy("_row")  # one byte range, at most maxPartitionBytes
    lines = lines.withColumn("_odd", F.pmod(quotes, F.lit(2)))
    lines = lines.withColumn("_before", F.pmod(F.coalesce(F.sum("_odd").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), F.lit(2)))
    ranges = lines.groupBy("_file", "_block").agg(
        F.pmod(F.sum("_odd"), F.lit(2)).alias("_parity"), F.count_if(F.col("_before") == 0).alias("_even"), F.count_if(F.col("_before") == 1).alias("_uneven")
    )
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    ranges = ranges.withColumn("_no", F.row_number().over(Window.orderBy("_file", "_block")).cast("long"))
    ranges = ranges.withColumn("_start", F.pmod(F.coalesce(F.sum("_parity").over(earlier), F.lit(0)), F.lit(2)))
    ranges = ranges.withColumn("_begins", F.when(F.col("_start") == 0, F.col("_even")).otherwise(F.col("_uneven")))
    ranges = ranges.withColumn("_open", F.last(F.when(F.col("_begins") > 0, F.struct("_no", F.col("_begins").alias("_at"))), ignorenulls=True).over(earlier))
    told = lines.join(ranges.select("_file", "_block", "_no", "_start", "_open"), ["_file", "_block"])
    told = told.withColumn("_begin", (F.pmod(F.col("_before") + F.col("_start"), F.lit(2)) == 0).cast("int"))
    told = told.withColumn("_at", F.sum("_begin").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    here = F.col("_at") > 0
    told = told.withColumn("_rec", F.when(here, F.struct("_no", F.col("_at").cast("long").alias("_at"))).otherwise(F.struct(F.col("_open._no").alias("_no"), F.col("_open._at").cast("long").alias("_at"))))
    told = told.withColumn("seq", F.shiftleft(F.col("_rec._no"), 33) + F.col("_rec._at")).withColumn("first", here & (F.col("_begin") == 1) & (F.col("_block") == 0) & (F.col("_at") == 1))
    alone = (F.col("_begin") == 1) & (F.col("_odd") == 0)
    whole = told.where(alone).select("seq", F.col("_file").alias("file"), "first", F.col("value").alias("text"))
    parts = told.where(~alone).groupBy("seq").agg(F.min("_file").alias("file"), F.max("first").alias("first"), F.array_sort(F.collect_list(F.struct("_no", "_row", "value"))).alias("l"))
    joined = parts.select("seq", "file", "first", F.array_join(F.col("l.value"), "\n").alias("text"))
    text = F.regexp_replace("text", r"\r\z", "")
    return whole.unionByName(joined).withColumn("text", text).where(F.col("text") != "")


def _read(spark: SparkSession, path: str) -> DataFrame:
    """(seq, file, text, the parsed record ``r``) of all records but headers."""
    names = _names(spark, path)
    quoted = lambda c: "`" + c.replace("`", "``") + "`"
    ddl = ", ".join(f"{quoted(c)} string" for c in [*names, MALFORMED])
    options = {"quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": MALFORMED}
    return _records(spark, path).where(~F.col("first")).select("seq", "file", "text", F.from_csv("text", ddl, options).alias("r"))


def malformed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line): the records that have more or fewer fields than the header."""
    return _read(spark, path).where(F.col(f"r.{MALFORMED}").isNotNull()).select("file", F.col("text").alias("line"))


def scan_csv(spark: SparkSession, path: str, malformed: str = "keep") -> DataFrame:
    """Header row, every column as text (``infer_numeric`` types it). One file
    is read by many tasks, line breaks in quoted fields included.

    ``ingest_seq`` is the input order: files by path, rows as in their file.
    Lines with missing or surplus fields are kept (missing ones NULL, surplus
    ones cut), or are an error with ``malformed="error"``;
    ``malformed_lines`` lists them whole."""
    if malformed == "error":
        n = malformed_lines(spark, path).count()
        if n:
            raise TableError("malformed_lines", str(n))
    rows = _read(spark, path)
    names = [f.name for f in rows.schema["r"].dataType.fields if f.name != MALFORMED]
    return rows.select(*[F.col("r").getField(c).alias(c) for c in names], F.col("seq").alias("ingest_seq"))


def infer_numeric(df: DataFrame, keep: tuple[str, ...] = ("ingest_seq",)) -> DataFrame:
    """Text columns whose every value is a number become numeric: bigint if
    all are whole and none is missing, else double; columns without any value
    become double. ``NA_TEXTS`` count as missing. One aggregate pass finds
    out; later steps clean what stays text."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in keep]
    if not texts:
        return df
    value = {c: F.when(~F.trim(F.col(f"`{c}`")).isin(*NA_TEXTS), F.col(f"`{c}`")) for c in texts}
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(texts):
        aggs += [F.count(value[c]).alias(f"n{i}"), F.count_if(value[c].rlike(_NUMERIC_TEXT)).alias(f"num{i}"), F.count_if(value[c].rlike(r"^\s*[+-]?\d{1,18}\s*$")).alias(f"int{i}")]
    seen = df.agg(*aggs).first()
    typed = {}
    for i, c in enumerate(texts):
        if seen[f"num{i}"] < seen[f"n{i}"]:
            typed[c] = value[c]
        elif seen[f"int{i}"] == seen["rows"] > 0:
            typed[c] = F.trim(value[c]).cast("bigint")
        else:
            typed[c] = F.trim(value[c]).try_cast("double")
    return df.withColumns(typed)


def reject_empty(df: DataFrame) -> DataFrame:
    """Error for a table with no columns or no rows (``isEmpty`` reads one row)."""
    if not [c for c in df.columns if c != "ingest_seq"]:
        raise TableError("no_columns")
    if df.isEmpty():
        raise TableError("no_rows")
    return df


def inline_rows(spark: SparkSession, rows: list[dict], min_rows: int = MIN_ROWS) -> DataFrame:
    """Hand-entered rows: keep rows with a non-empty id; require ``min_rows``."""
    cols = ["customer_id", "last_purchase_date", "total_orders", "total_spend"]
    data = [tuple(None if r.get(c) is None else str(r.get(c)) for c in cols) for r in rows]
    df = spark.createDataFrame(data, ", ".join(f"{c} string" for c in cols))
    df = df.where(F.length(F.coalesce(F.col("customer_id"), F.lit(""))) > 0)
    df = df.withColumn("ingest_seq", F.monotonically_increasing_id())
    found = df.count()  # literal input: at most a handful of rows
    if found < min_rows:
        raise TableError("too_few_rows", f"{found} of {min_rows}")
    return df


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """CSV sink with a header row (one part file per partition)."""
    df.write.mode(mode).options(header="true", quote='"', escape='"').csv(path)
    return path


def sink_segment_csv(df: DataFrame, path: str) -> str:
    """The filtered table with all its columns, as the segment download."""
    return write_csv(df.drop("ingest_seq") if "ingest_seq" in df.columns else df, path)


def scan_active(user_table: DataFrame | None, default_table: DataFrame) -> DataFrame:
    """The user's table when one was loaded, else the default table."""
    return user_table if user_table is not None else default_table
