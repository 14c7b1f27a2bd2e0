"""Archives: exact round trips, jumps, pushdown, commits."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json

import pytest
from pyspark.sql import functions as F

from trialmart.llm import warc

PAGES = "page_id long, url string, html string"


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_round_trip_by_the_book(spark):
    rows = [
        (1, "u", "abc"), (2, "u", "abc"), (2, "u", "abc"), (3, None, None), (4, "v", ""),
        (None, "w", "abc"), (7, "x\r\ny", "é\r\n\r\nWARC/1.1\r\n"), (8, "z", "q" * 300_000),
    ]
    found = warc.round_trip(spark.createDataFrame(rows, PAGES)).collect()
    last = {}
    for i, _, html in rows:
        last[digest(html)] = max(last.get(digest(html), -1), -1 if i is None else i)
    want = []
    for i, _, html in rows:
        d = digest(html)
        revisit = i != last[d]
        want.append((i, len((html or "").encode()), d, "revisit" if revisit else "response",
                     last[d] if revisit else None))
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)


def test_without_ids_all_are_responses_and_empty_tables_work(spark):
    rows = [(None, "u", "same"), (None, "u", "same")]
    found = warc.round_trip(spark.createDataFrame(rows, PAGES)).collect()
    assert {r["record_type"] for r in found} == {"response"}
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


class Memory(io.BytesIO):
    def __init__(self, data):
        super().__init__(data)
        self.bytes_read = 0

    def size(self):
        return len(self.getvalue())

    def read(self, n=-1):
        data = super().read(n)
        self.bytes_read += len(data)
        return data


RECORDS = [
    {"record_id": f"r{i}", "record_type": "response" if i % 2 else "warcinfo",
     "payload": bytes([i]) * 200 + hashlib.sha512(bytes([i])).digest() * 4000}
    for i in range(6)
]


@pytest.mark.parametrize("pack", ["lengths", "plain gzip", "none"])
def test_records_in_every_packing(pack):
    packed = {
        "lengths": warc.gzip_member, "plain gzip": gzip.compress, "none": lambda r: r,
    }[pack]
    data = b"".join(packed(warc.make_record(r)) for r in RECORDS)
    found = list(warc.read_records(Memory(data), lambda f: True, True))
    assert [p for _, _, p in found] == [r["payload"] for r in RECORDS]
    some = list(warc.read_records(Memory(data), lambda f: f["WARC-Type"] == "response", True))
    assert [f["WARC-Record-ID"] for _, f, _ in some] == ["<r1>", "<r3>", "<r5>"]
    with pytest.raises((EOFError, ValueError)):
        list(warc.read_records(Memory(data[:-300_000] if pack == "none" else data[:-600]),
                               lambda f: True, True))


def test_unwanted_payloads_are_jumped_over():
    incompressible = b"".join(hashlib.sha512(str(i).encode()).digest() for i in range(20_000))
    data = b"".join(
        warc.gzip_member(warc.make_record({"record_id": str(i), "payload": incompressible}))
        for i in range(5)
    )
    file = Memory(data)
    assert len(list(warc.read_records(file, lambda f: False, True))) == 0
    assert file.bytes_read < len(data) / 4


def test_pushdown_prunes_in_the_source(spark, tmp_path):
    rows = [(i, f"http://h{i % 3}/p", f"body {i}") for i in range(30)]
    warc.write_warc(warc.page_records(spark.createDataFrame(rows, PAGES)), str(tmp_path / "a"))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = warc.read_warc(spark, str(tmp_path / "a"), columns="record_id string, target_uri string, record_type string")
        cut = df.where(F.col("target_uri").startswith("http://h1/") & (F.col("record_type") == "response"))
        plan = cut._jdf.queryExecution().executedPlan().toString()
        assert cut.count() == 10
        assert "StartsWith(target_uri" not in plan.split("BatchScan")[0]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert warc.read_warc(spark, str(tmp_path / "a"), uri_prefix="http://h2/").count() == 10
    assert warc.read_warc(spark, str(tmp_path / "a"), record_types=("revisit",)).count() == 0


def test_only_committed_archives_are_read(spark, tmp_path):
    rows = [(i, "u", str(i)) for i in range(4)]
    folder = tmp_path / "a"
    warc.write_warc(warc.page_records(spark.createDataFrame(rows, PAGES)), str(folder))
    (folder / "part-lost.warc.gz").write_bytes(b"left over by a lost task")
    assert warc.read_warc(spark, str(folder)).count() == 4
    warc.write_warc(warc.page_records(spark.createDataFrame(rows, PAGES)), str(folder))
    assert warc.read_warc(spark, str(folder)).count() == 8
    names = json.loads((folder / "_committed").read_text())
    (folder / names[0]).unlink()
    with pytest.raises(Exception, match="are gone"):
        warc.read_warc(spark, str(folder)).count()


def test_every_folder_follows_its_own_list(spark, tmp_path):
    for name, ids in (("a", range(3)), ("b", range(3, 8))):
        rows = [(i, "u", str(i)) for i in ids]
        warc.write_warc(warc.page_records(spark.createDataFrame(rows, PAGES)), str(tmp_path / "top" / name))
    (tmp_path / "top" / "a" / "part-lost.warc.gz").write_bytes(b"left over by a lost task")
    (tmp_path / "top" / "plain").mkdir()
    loose = warc.gzip_member(warc.make_record({"record_id": "loose", "payload": b"x"}))
    (tmp_path / "top" / "plain" / "c.warc.gz").write_bytes(loose)
    assert warc.read_warc(spark, str(tmp_path / "top")).count() == 3 + 5 + 1
    names = json.loads((tmp_path / "top" / "b" / "_committed").read_text())
    (tmp_path / "top" / "b" / names[0]).unlink()
    with pytest.raises(Exception, match="are gone"):
        warc.read_warc(spark, str(tmp_path / "top")).count()
