"""Driver contract, sources and sinks."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL


def test_entry_runs(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["rfm_segment", "total_spend"]


def test_every_query_has_unique_name():
    import __spark_entry__ as e

    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 80


def test_csv_round_trip_and_reject_empty(spark, tmp_path):
    from segmint.sources.files import reject_empty, scan_csv, write_csv

    src = spark.createDataFrame([("a", "1"), ("b", "2")], "customer_id string, total_orders string")
    path = str(tmp_path / "c")
    write_csv(src.coalesce(1), path)
    back = reject_empty(scan_csv(spark, path))
    assert sorted(r["customer_id"] for r in back.collect()) == ["a", "b"]
    assert "ingest_seq" in back.columns
    empty = str(tmp_path / "e")
    write_csv(src.limit(0).coalesce(1), empty)
    with pytest.raises(ValueError):
        reject_empty(scan_csv(spark, empty))


def test_csv_quotes_line_breaks_and_order(spark, tmp_path):
    from segmint.operators.enrich import dedup_keep_last
    from segmint.sources.files import TableError, malformed_lines, scan_csv, write_csv

    folder = tmp_path / "many"
    folder.mkdir()
    (folder / "part-0.csv").write_text('customer_id,note\na,first\nb,"two\nlines"\n')
    (folder / "part-1.csv").write_text('customer_id,note\na,"the ""last"" one, ' + "x" * 500 + '"\n')
    rows = scan_csv(spark, str(folder)).orderBy("ingest_seq").collect()
    assert [r["customer_id"] for r in rows] == ["a", "b", "a"] and rows[1]["note"] == "two\nlines"
    last = {r["customer_id"]: r["note"] for r in dedup_keep_last(scan_csv(spark, str(folder))).collect()}
    assert last["a"].startswith('the "last" one, x')
    src = spark.createDataFrame([("a", 'q"uo,te'), ("b", "two\nlines")], "customer_id string, note string")
    path = str(tmp_path / "out")
    write_csv(src.coalesce(1), path)
    assert sorted((r["customer_id"], r["note"]) for r in scan_csv(spark, path).collect()) == [("a", 'q"uo,te'), ("b", "two\nlines")]
    bad = tmp_path / "bad.csv"
    bad.write_text("customer_id,note\na,b\nc,d,e\nf\n")
    assert malformed_lines(spark, str(bad)).count() == 2 and scan_csv(spark, str(bad)).count() == 3
    with pytest.raises(TableError):
        scan_csv(spark, str(bad), malformed="error")


def test_typed_scan(spark, tmp_path):
    from segmint.operators.enrich import enrich
    from segmint.sources.files import infer_numeric, scan_csv

    f = tmp_path / "t.csv"
    f.write_text("customer_id,last_purchase_date,total_orders,total_spend,extra,empty,code\n1,2024-01-01,3,1e5,7,,x1\n2,2024-01-02,4,20,NA,,2\n3,2024-01-03,5,30,9,n/a,3\n")
    df = infer_numeric(scan_csv(spark, str(f)))
    assert dict(df.dtypes) | {"x": 0} == {"customer_id": "bigint", "last_purchase_date": "string", "total_orders": "bigint", "total_spend": "double", "extra": "double", "empty": "double", "code": "string", "ingest_seq": "bigint", "x": 0}
    rows = {r["customer_id"]: r for r in enrich(df, "2024-02-01").collect()}
    assert rows["1"]["total_spend"] == 100000.0 and rows["2"]["extra"] == 8.0 and rows["1"]["code"] == "x1"


def test_customers_without_orders_stay(spark):
    from segmint.sources.snapshot import customer_snapshot
    from segmint.sources.tables import Tables

    t = Tables(spark, "/root/testdata/sf0.1")
    snap = customer_snapshot(t)
    assert snap.count() == t.customer.count()
    until = t.events.agg(F.min("ts")).first()[0]
    assert customer_snapshot(t, events_until=until).agg(F.sum("support_tickets_raised")).first()[0] < snap.agg(F.sum("support_tickets_raised")).first()[0]


def test_inline_rows_requires_three(spark):
    from segmint.sources.files import inline_rows

    with pytest.raises(ValueError):
        inline_rows(spark, [{"customer_id": "a"}, {"customer_id": ""}, {"customer_id": "b"}])
    df = inline_rows(spark, [{"customer_id": c, "total_orders": 1} for c in "abc"])
    assert df.count() == 3


def test_snapshot_small(spark):
    from segmint.plans import base

    snap = base.snapshot(spark, SF_SMALL)
    assert snap.count() == snap.select("customer_id").distinct().count()
    assert snap.count() == spark.read.parquet(f"{SF_SMALL}/customer.parquet").count()
    assert snap.where("total_orders is null or total_spend is null").count() == 0


def test_validation_flags_missing_required(spark):
    from segmint.operators.quality import is_valid, validation_report

    df = spark.createDataFrame([("a", "2")], "customer_id string, total_orders string")
    rep = validation_report(df)
    assert not is_valid(rep)
    missing = {r["column"] for r in rep.where(F.col("check") == "missing_required").collect()}
    assert missing == {"last_purchase_date", "total_spend", "days_since_last_purchase"}


def test_checkpoint_dir_is_set(spark):
    assert spark.sparkContext.getCheckpointDir()
    assert os.environ.get("HOME") is not None


def test_multi_date_snapshot_equals_single_snapshots(spark):
    import datetime as dt

    from segmint.plans import base
    from segmint.sources.snapshot import customer_snapshot, customer_snapshots
    from segmint.sources.tables import Tables

    t = Tables(spark, SF_SMALL)
    at = base.as_of(spark, SF_SMALL)
    dates = [at - dt.timedelta(days=400), at]
    both = customer_snapshots(t, dates)
    for d in dates:
        one = sorted(map(tuple, customer_snapshot(t, d).collect()))
        got = sorted(map(tuple, both.where(F.col("as_of") == F.lit(d).cast("timestamp_ntz")).drop("as_of").collect()))
        assert got == one


def test_active_table_is_the_users_when_loaded(spark):
    from segmint.plans import base, ingest
    from segmint.sources.files import scan_active

    default = base.customers(spark, SF_SMALL)
    upload = ingest.uploaded_file(spark, SF_SMALL)
    assert scan_active(None, default) is default
    assert scan_active(upload, default) is upload
    assert "Cust ID" not in upload.columns and upload.count() == default.count()


def test_own_reports_equal_the_whole_report(spark):
    from segmint.operators import quality as Q
    from segmint.plans import ingest

    up = ingest.uploaded_file(spark, SF_SMALL)
    report = Q.validation_report(up).collect()
    assert {(r["column"], r["null_count"]) for r in Q.null_summary(up).collect()} == {(r["column"], int(r["value"])) for r in report if r["check"] == "null_count"}
    assert {(r["column"], r["bad_share"], r["flagged"]) for r in Q.type_issues(up).collect()} == {(r["column"], r["value"], r["status"] == "issue") for r in report if r["check"] == "type_issue"}
    empty = up.limit(0)
    assert all(r["null_count"] == 0 for r in Q.null_summary(empty).collect()) and not any(r["flagged"] for r in Q.type_issues(empty).collect())


@pytest.mark.parametrize("size", [7, 40, 1000])
def test_one_file_read_by_many_tasks_equals_a_plain_parse(spark, tmp_path, request, size):
    import csv
    import random

    from segmint.sources.files import scan_csv

    rng = random.Random(size)
    field = lambda: "".join(rng.choice(["a", "b", '"', ",", "\n", "é", " ", "\r\n", "x" * 9]) for _ in range(rng.randrange(0, 6)))
    folder = tmp_path / "files"
    folder.mkdir()
    expected = []
    for name in ("a.csv", "b.csv"):
        rows = [(f"{name}{i}", field(), field()) for i in range(40)]
        with open(folder / name, "w", newline="", encoding="utf-8") as f:
            w = csv.writer(f, lineterminator="\n" if name == "a.csv" else "\r\n", quoting=csv.QUOTE_ALL)
            w.writerow(("id", "one", "two"))
            w.writerows(rows)
        expected += rows
    for key, value in (("spark.sql.files.maxPartitionBytes", str(size)), ("spark.sql.files.openCostInBytes", "1")):
        old = spark.conf.get(key)
        request.addfinalizer(lambda key=key, old=old: spark.conf.set(key, old))
        spark.conf.set(key, value)
    df = scan_csv(spark, str(folder))
    got = [(r["id"], r["one"] or "", r["two"] or "") for r in df.orderBy("ingest_seq").collect()]
    assert got == expected
