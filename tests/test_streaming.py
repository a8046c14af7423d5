"""Streaming order aggregates equal the batch aggregates, file by file."""

from pyspark.sql import functions as F

from conftest import SF_SMALL


def test_stream_matches_batch(spark, tmp_path):
    from segmint.streaming.snapshot_stream import run_order_aggregates

    orders = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    land = tmp_path / "landing"
    for i in range(3):  # three arrivals; customers recur across files
        orders.where(F.pmod("o_orderkey", F.lit(3)) == i).coalesce(1).write.mode("append").parquet(str(land))
    got = run_order_aggregates(spark, str(land), "part-*.parquet", out_path=str(tmp_path / "out"))
    want = orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total_spend"),
        F.max("o_orderdate").alias("last_purchase_date"),
        F.min("o_orderdate").alias("signup_date"),
    )
    cols = ["o_custkey", "total_orders", "total_spend", "last_purchase_date", "signup_date"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
