"""Archives: round trips, push-down, skipped payloads, revisits."""

import gzip
import hashlib
import io

import pytest

from segmint.llm import warc
from segmint.llm.queries import op10_warc

ROWS = [
    (1, "http://a/", "x" * 150), (2, "http://b/", "x" * 150), (2, "http://b/", "x" * 150), (3, None, "short"), (4, "http://c/\r\nX: y", "short"),
    (None, "http://d/", "x" * 150), (5, "http://e/é", None), (6, "http://f/", ""), (7, "http://g/", "ü\r\n\r\nWARC/1.1\r\n" * 9000),
]


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(i, u, h, "c") for i, u, h in rows], "page_id long, url string, html string, payload string")


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_round_trip(spark, tmp_path, compression):
    path = str(tmp_path / "w")
    warc.write_archive(warc.page_records(pages(spark)).repartition(3), path, compression=compression)
    back = warc.read_archive(spark, path).collect()
    want = sorted(((h or "").encode() for _, _, h in ROWS), key=len)
    responses = sorted((bytes(r["payload"]) for r in back if r["record_type"] == "response"), key=len)
    assert len(back) == len(ROWS) and len(responses) == len(ROWS) - 3
    assert [p for p in want if p != b"x" * 150] + [b"x" * 150] == sorted(responses, key=lambda p: (p == b"x" * 150, len(p)))
    for r in back:
        if r["record_type"] == "revisit":
            assert r["payload"] is None and r["payload_length"] == 150 and r["refers_to"] == "<urn:page:1>"
        else:
            assert r["payload_digest"] == "sha256:" + hashlib.sha256(bytes(r["payload"])).hexdigest()
    lean = warc.read_archive(spark, path, payload="false").collect()
    assert all(r["payload"] is None for r in lean)
    assert sorted(r["payload_length"] for r in lean) == sorted(r["payload_length"] for r in back)


def test_filters_are_pushed_down(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archive(warc.page_records(pages(spark)), path)
    df = warc.read_archive(spark, path)
    only = df.where("record_type = 'revisit' and target_uri like 'http://b%'")
    assert only.count() == 2
    plan = only._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan and "+- Filter" not in plan  # nothing is left for Spark to filter
    assert df.where("target_uri is null").count() == 1 and df.where("record_type in ('response', 'x')").count() == len(ROWS) - 3


def test_unwanted_payloads_are_not_inflated():
    rows = [{"record_id": f"<r{i}>", "record_type": "response", "date": "d", "payload": bytes([i]) * 200_000} for i in range(20)]
    data = b"".join(warc.gzip_member(warc.record_bytes(r), 1) for r in rows)
    seen = []

    class File(io.BytesIO):
        def read(self, n=-1):
            out = super().read(n)
            seen.append(len(out))
            return out

    got = list(warc.read_records(File(data), True, lambda h: h["warc-record-id"] == "<r7>", True))
    assert [(h["warc-record-id"], n, p) for h, n, p in got] == [("<r7>", 200_000, rows[7]["payload"])]
    # any gzip reader can read the members, and members without lengths are read too
    assert gzip.decompress(data) == b"".join(map(warc.record_bytes, rows))
    plain = b"".join(gzip.compress(warc.record_bytes(r)) for r in rows)
    assert [p for _, _, p in warc.read_records(io.BytesIO(plain), True, lambda h: True, True)] == [r["payload"] for r in rows]
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(data[:-50]), True, lambda h: True, True))


def test_only_committed_files_are_read(spark, tmp_path):
    path = tmp_path / "w"
    warc.write_archive(warc.page_records(pages(spark)), str(path))
    (path / "part-left-over.warc").write_bytes(warc.record_bytes({"record_id": "<x>", "record_type": "response", "date": "d", "payload": b"z"}))
    assert warc.read_archive(spark, str(path)).count() == len(ROWS)
    warc.write_archive(warc.page_records(pages(spark, ROWS[:1])), str(path))
    assert warc.read_archive(spark, str(path)).count() == len(ROWS) + 1
    empty = str(tmp_path / "e")
    warc.write_archive(warc.page_records(pages(spark, [])), empty)
    assert warc.read_archive(spark, empty).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    first: dict = {}
    for r in rows:
        p = (r["html"] or "").encode()
        if len(p) >= 100:
            first[p] = min(first.get(p, r["page_id"]), r["page_id"])
    want = {}
    for r in rows:
        p = (r["html"] or "").encode()
        again = len(p) >= 100 and first[p] != r["page_id"]
        want[r["page_id"]] = (len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", first[p] if again else None)
    got = {r["page_id"]: tuple(r)[1:] for r in op10_warc(spark, sf).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()}
    assert got == want
