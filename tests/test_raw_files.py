"""Raw files that many tasks write and read, and short chunks that cost no more than their bytes."""

from __future__ import annotations

import gzip
import json
import random

from trialmart.plans import catalog
from trialmart.sources import byte_access, gzip_index, manifest, readers, sinks

ROWS = [(i, f"name {i}, \"x\"") for i in range(2000)]


def test_one_gzip_file_from_many_tasks(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "id long, name string")
    sinks.write_gzip_files(df, str(tmp_path), ["a.json.gz", "b.json.gz"], "json", 8)
    sinks.write_gzip_files(df, str(tmp_path), ["c.csv.gz"], "csv", 5, header=True)
    sinks.write_gzip_files(df.limit(0), str(tmp_path), ["d.json.gz"], "json", 3)
    sinks.write_gzip_files(df.limit(0), str(tmp_path), ["e.csv.gz"], "csv", 3, header=True)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.json.gz", "b.json.gz", "c.csv.gz", "d.json.gz", "e.csv.gz"]
    found = {r["name"]: r for r in manifest.file_manifest(spark, str(tmp_path)).collect()}
    assert all(r["ok"] for r in found.values())
    # Each task's rows are a gzip member of the file.
    assert found["a.json.gz"]["members"] == found["b.json.gz"]["members"] == 4 and found["c.csv.gz"]["members"] == 6
    assert found["a.json.gz"]["lines"] + found["b.json.gz"]["lines"] == 2000 and found["c.csv.gz"]["lines"] == 2001
    assert found["d.json.gz"]["lines"] == 0 and found["e.csv.gz"]["lines"] == 1
    back = spark.read.json([str(tmp_path / "a.json.gz"), str(tmp_path / "b.json.gz")])
    assert sorted((r["id"], r["name"]) for r in back.collect()) == ROWS
    csv = spark.read.option("header", True).option("escape", "\\").csv(str(tmp_path / "c.csv.gz"))
    assert csv.columns == ["id", "name"] and sorted((int(r["id"]), r["name"]) for r in csv.collect()) == ROWS


def test_lines_of_one_gzip_file_are_read_by_many_tasks(spark, tmp_path):
    lines = [json.dumps({"order_id": i, "more": "é" * (i % 7), "items": [i]}) for i in range(3000)]
    lines[5:5] = ["", "{broken", '[{"order_id": "x"}, {"order_id": "y"}]']
    path = tmp_path / "order.json.gz"
    path.write_bytes(b"".join(
        gzip.compress(("﻿" * (not k) + "\n".join(lines[k : k + 500]) + "\n").encode()) for k in range(0, len(lines), 500)
    ))
    found = readers.read_orders_json(spark, str(path), chunk_bytes=4096)
    assert found.rdd.getNumPartitions() > 3
    plain = tmp_path / "order.json"
    plain.write_text("\n".join(lines) + "\n")
    want = readers.read_orders_json(spark, str(plain))
    assert found.columns == want.columns and "more" in found.columns
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))


def test_short_chunks_read_and_decompress_little(spark, tmp_path):
    rng = random.Random(4)
    text = "".join(f"{rng.random()} {i}\n" for i in range(200_000)).encode()
    (tmp_path / "x.txt").write_bytes(text)
    (tmp_path / "x.txt.gz").write_bytes(gzip.compress(text))
    step = 1 << 17
    for row in (r.asDict() for r in gzip_index.chunks(spark, str(tmp_path), chunk_bytes=step).collect()):
        if row["start"]:
            row["path"] = row["path"].removeprefix("file:")
            stream = byte_access.open_chunk(row)
            piece = next(stream.pieces())
            assert len(piece) <= max(byte_access.BEFORE, row["end"] - row["start"])
            assert text[row["start"] : row["start"] + len(piece)] == piece
            stream.close()


def test_many_chunks_share_tasks(spark):
    rows = spark.range(5000).selectExpr("id * 10 as start", "id * 10 + 10 as end")
    assert byte_access.spread_chunks(rows).rdd.getNumPartitions() == 64
    large = spark.range(200).selectExpr("id * 33554432 as start", "(id + 1) * 33554432 as end")
    assert byte_access.spread_chunks(large).rdd.getNumPartitions() == 200
    assert byte_access.spread_chunks(rows.limit(0)).count() == 0


def test_more_files_for_larger_tables(spark, tmp_path, monkeypatch):
    spark.range(1000).write.parquet(str(tmp_path / "orders.parquet"))
    assert catalog._parts(spark, str(tmp_path), "orders", 2) == 2
    monkeypatch.setattr(catalog, "_PARQUET_BYTES", 100)
    assert catalog._parts(spark, str(tmp_path), "orders", 2) > 10
