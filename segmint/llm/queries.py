"""Registered queries of the text operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import byte_bpe, conversation_repair, divergence, fingerprints, jaccard_join, license_scan, packing, quality, rank_bpe, sql, substring_dedup, token_count, toxicity, warc
from .common import table


def op5_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def token_digests(separator: str):
    """n_tokens, ids_sha256 (decimal ids with the separator between them) and
    decoded_sha256 from the ids and the decoded texts or bytes of rows."""
    import hashlib

    import pyarrow as pa

    def hexed(x) -> str:
        return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()

    def columns(ids: list, decoded: list) -> list:
        listed = [hexed(separator.join(map(str, x.tolist()))) for x in ids]
        return [pa.array([len(x) for x in ids], pa.int64()), pa.array(listed, pa.string()), pa.array([hexed(d) for d in decoded], pa.string())]

    return "n_tokens bigint, ids_sha256 string, decoded_sha256 string", columns


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), finish=token_digests(","))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(table(spark, sf_dir, "documents"), keep={"ids_crc32": F.crc32("ids")})
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprints.neighbours(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_documents(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.removed_passages(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start_byte", "end_byte", "n_words", "kept_doc_id")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes every page, reads the archives back; the digest of a response
    is that of the bytes read."""
    path = scratch_path(spark, "warc")
    warc.write_archive(warc.page_records(table(spark, sf_dir, "pages")), path)
    back = warc.read_archive(spark, path)
    ident = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    return back.select(
        ident(F.col("record_id")).alias("page_id"),
        F.coalesce(F.octet_length("payload").cast("long"), F.col("payload_length")).alias("payload_bytes"),
        F.coalesce(F.sha2("payload", 256), F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
        "record_type",
        ident(F.col("refers_to")).alias("refers_to"),
    )


def op11_rank_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = rank_bpe.round_trip(docs, finish=token_digests(" "))
    return out.drop("text")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_conversations(table(spark, sf_dir, "conversations"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_fingerprints": op2_fingerprints,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_license_scan": op4_license_scan,
    "op5_token_count": op5_token_count,
    "op6_toxicity": op6_toxicity,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_quality_rules": op8_quality_rules,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_warc": op10_warc,
    "op11_rank_bpe": op11_rank_bpe,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_source_divergence": op13_source_divergence,
}

ORACLE: dict[str, str] = {
    "op4_license_scan": sql.op4(license_scan.SENTENCES, license_scan.RULES),
    "op8_quality_rules": sql.OP8,
    "op10_warc": sql.OP10,
    "op12_conversation_repair": sql.OP12,
    "op13_source_divergence": sql.OP13,
}
