"""Readers, checks and writers on temporary folders."""

from __future__ import annotations

import gzip
import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from trialmart.operators.conform import conform_abmap, conform_orders
from trialmart.plans.silver import clean_and_conform
from trialmart.sources import archives, files, readers, sinks
from trialmart.sources.storage import drop_staged, shared_dir, stage

ORDERS = [
    {"order_id": str(i), "customer_id": f"c{i % 3}", "merchant_id": "m", "cpf": "1",
     "order_created_at": f"2019-01-0{i + 1}T10:00:00.000Z", "order_total_amount": 10.5 * i,
     "order_scheduled": False, "items": [{"name": "x", "n": 1}] * i}
    for i in range(5)
]


def write_gz(path, text):
    with gzip.open(path, "wt", encoding="utf-8") as f:
        f.write(text)


def csv_text(rows):
    return "customer_id,is_target\n" + "".join(f"c{i},{v}\n" for i, v in enumerate(rows))


def add(tar, name, text):
    info = tarfile.TarInfo(name)
    data = text.encode()
    info.size = len(data)
    tar.addfile(info, io.BytesIO(data))


@pytest.fixture
def raw_dir(tmp_path):
    root = tmp_path / "raw"
    root.mkdir()
    write_gz(root / "order.json.gz", "".join(json.dumps(o) + "\n" for o in ORDERS))
    write_gz(root / "consumer.csv.gz", "customer_id,language,active\nc0,PT-br,true\nc1,,false\n")
    write_gz(root / "restaurant.csv.gz", "id,price_range,delivery_time\nm,3,40\n")
    with tarfile.open(root / "ab_test_ref.tar.gz", "w:gz") as tar:
        add(tar, "ref/._map.csv", "junk")
        add(tar, "ref/.DS_Store", "junk")
        add(tar, "ref/map.csv", csv_text(["treatment", "control"]))
        add(tar, "ref/more.csv", csv_text(["control"] * 3))
    folder = root / "ab_test_ref_extracted" / "deep"
    folder.mkdir(parents=True)
    (folder / "map.csv").write_text(csv_text(["control", "treatment"] + ["control"] * 200))
    (folder / "tiny.csv").write_text("customer_id,is_target\n")
    (folder / "._map.csv").write_text("x" * 4000)
    return root


def test_load_raw_to_fact(spark, raw_dir):
    raw = readers.load_raw(spark, str(raw_dir))
    assert {k: v.count() for k, v in raw.items()} == {
        "orders": 5, "consumers": 2, "restaurants": 1, "abmap": 202,
    }
    joined = clean_and_conform(**raw)
    rows = {r["order_id"]: r for r in joined.collect()}
    assert rows["1"]["is_target"] == 1 and rows["1"]["basket_size"] == 1
    assert rows["3"]["language"] == "pt-br" and rows["3"]["price_range"] == 3
    assert rows["2"]["active"] is None and "cpf" not in joined.columns


def test_preflight_report(spark, raw_dir):
    report = {r["key"]: r for r in files.preflight(spark, str(raw_dir)).collect()}
    assert all(r["problem"] is None for r in report.values())
    assert report["orders"]["readable"] and report["orders"]["size_bytes"] > 0
    assert report["ab_csv"]["size_bytes"] == 2


def test_preflight_names_every_problem(spark, tmp_path):
    root = tmp_path / "broken"
    (root / "sub").mkdir(parents=True)
    (root / "order.json.gz").write_bytes(b"\x1f\x8bnot gzip at all")
    (root / "ab_test_ref.tar.gz").write_bytes(b"neither")
    write_gz(root / "sub" / "consumer.csv.gz", "customer_id\n1\n")
    report = files.preflight(spark, str(root), strict=False).collect()
    assert [r["key"] for r in report if r["problem"]] == [
        "orders", "consumers", "restaurants", "ab_tar", "ab_csv",
    ]
    with pytest.raises(RuntimeError, match="unreadable gzip(.|\n)*missing file: consumers"):
        readers.load_raw(spark, str(root))


def test_preflight_of_missing_folder(spark, tmp_path):
    report = files.preflight(spark, str(tmp_path / "nowhere"), strict=False)
    assert report.where("exists").count() == 0


def test_small_assignment_files_are_read(spark, tmp_path):
    folder = tmp_path / "maps"
    (folder / "deep").mkdir(parents=True)
    (folder / "many.csv").write_text(csv_text(["1"] * 300))
    (folder / "deep" / "few.csv").write_text(csv_text(["0"] * 50))
    (folder / "._many.csv").write_text("companion")
    assert readers.read_abmap(spark, str(folder)).count() == 350
    assert readers.read_abmap(spark, str(folder), min_bytes=1024).count() == 300
    names = [r["name"] for r in files.list_valid_ab_csvs(spark, str(folder)).collect()]
    assert names == ["many.csv", "few.csv"]
    with pytest.raises(FileNotFoundError):
        readers.read_abmap(spark, str(tmp_path / "none"))


def test_headers_in_another_order_are_refused(spark, tmp_path):
    folder = tmp_path / "maps"
    folder.mkdir()
    (folder / "a.csv").write_text(csv_text(["1"] * 5))
    (folder / "b.csv").write_text("is_target,customer_id\n" + "0,c9\n" * 5)
    with pytest.raises(Exception, match="CSV header does not conform"):
        readers.read_abmap(spark, str(folder)).collect()


def test_all_order_columns_are_kept(spark, tmp_path):
    rows = [{**ORDERS[0], "city": "x"}, {**ORDERS[1], "weight": 1.5}]
    (tmp_path / "o.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
    found = readers.read_orders_json(spark, str(tmp_path / "o.json"))
    assert {"city", "weight", "cpf", "merchant_timezone"} <= set(found.columns)
    assert {(r["city"], r["weight"]) for r in found.collect()} == {("x", None), (None, "1.5")}
    listed = readers.read_orders_json(spark, str(tmp_path / "o.json"), extra_fields=["city"])
    assert "city" in listed.columns and "weight" not in listed.columns
    assert "city" in conform_orders(found).columns


def test_unfinished_shards_are_refused_and_rebuilt(spark, raw_dir):
    shards = raw_dir / "orders_sharded"
    shards.mkdir()
    (shards / "part-00000.json").write_text(json.dumps(ORDERS[0]) + "\n")
    with pytest.raises(RuntimeError, match="unfinished"):
        readers.read_orders(spark, str(raw_dir))
    assert readers.read_orders(spark, str(raw_dir), trust_foreign_shards=True).count() == 1
    archives.shard_ndjson(spark, str(raw_dir / "order.json.gz"), str(shards))
    assert readers.read_orders(spark, str(raw_dir)).count() == 5


def test_cut_gzip_is_named(spark, raw_dir):
    path = raw_dir / "consumer.csv.gz"
    write_gz(path, "customer_id\n" + "".join(f"{i * 7919 % 99991}\n" for i in range(90_000)))
    whole = path.read_bytes()
    assert files.is_readable_text(spark, str(path))
    path.write_bytes(whole[: len(whole) // 2])
    assert not files.is_readable_text(spark, str(path))
    with pytest.raises(RuntimeError, match="unreadable gzip: consumer"):
        files.preflight(spark, str(raw_dir))


def test_preflight_details(spark, raw_dir):
    (raw_dir / "orders.json").write_text("{}")
    report = {r["key"]: r for r in files.preflight(spark, str(raw_dir), min_bytes=100).collect()}
    assert report["orders"]["detail"] == "format: ndjson_or_objects; candidates: orders.json"
    assert report["orders"]["lines_read"] == 5 and report["consumers"]["lines_read"] == 3
    assert "ref/map.csv" in report["ab_tar"]["detail"]
    assert report["ab_csv"]["detail"] == "1 files under 100 bytes are left out"


def test_tar_members_with_columns_in_another_order(spark, tmp_path):
    path = tmp_path / "a.tar.gz"
    with tarfile.open(path, "w:gz") as tar:
        add(tar, "a.csv", 'customer_id,is_target\nc1,1\n"c,\n2",0\n')
        add(tar, "b.csv", "is_target,customer_id\n0,c3\n")
        add(tar, "empty.csv", "")
    table = archives.read_tar_csv(spark, str(path))
    assert {tuple(r) for r in table.collect()} == {("c1", "1"), ("c,\n2", "0"), ("c3", "0")}
    with tarfile.open(path, "w:gz") as tar:
        add(tar, "a.csv", csv_text(["1"]))
        add(tar, "b.csv", "customer_id,other\nc,1\n")
    with pytest.raises(ValueError, match="differ in columns"):
        archives.read_tar_csv(spark, str(path))


def test_staged_tables_can_be_dropped(spark):
    df = stage(spark.range(5), "short-lived")
    kept = stage(spark.range(3), "kept")
    drop_staged(spark, "short-lived")
    with pytest.raises(Exception):
        spark.read.parquet(df.inputFiles()[0]).count()
    assert kept.count() == 3


@pytest.mark.parametrize(
    "text, kind",
    [("\n  [\n{}]", "json_array"), ('{"a": 1}\n', "ndjson_or_objects"), ("", "ndjson_or_objects")],
)
def test_sniff(spark, tmp_path, text, kind):
    path = tmp_path / "o.json.gz"
    write_gz(path, text)
    assert files.sniff_orders_format(spark, str(path)) == kind
    assert files.sniff_orders_format(spark, str(tmp_path / "none")) == "missing"


def test_array_and_lines_give_the_same_orders(spark, raw_dir):
    path = raw_dir / "array.json.gz"
    write_gz(path, json.dumps(ORDERS, indent=1))
    array = readers.read_orders_json(spark, str(path), json_array=True)
    lines = readers.read_orders(spark, str(raw_dir))
    # The text of the items keeps the spacing of its file.
    a, b = (sorted(conform_orders(d).drop("items").collect(), key=str) for d in (array, lines))
    assert a == b and len(a) == 5


def test_shards_come_first(spark, raw_dir):
    target = raw_dir / "orders_sharded"
    shards = archives.shard_ndjson(spark, str(raw_dir / "order.json.gz"), str(target), parts=3)
    assert shards.count() == 5 and len(list(target.glob("part-*"))) == 3
    (raw_dir / "order.json.gz").rename(raw_dir / "renamed.json.gz")
    assert readers.read_orders(spark, str(raw_dir)).count() == 5
    # A second run leaves existing shards alone.
    write_gz(raw_dir / "other.json.gz", "{}\n" * 9)
    again = archives.shard_ndjson(spark, str(raw_dir / "other.json.gz"), str(target))
    assert again.count() == 5


def test_tar_members(spark, raw_dir):
    path = str(raw_dir / "ab_test_ref.tar.gz")
    names = [r["member"] for r in archives.preview_tar_members(spark, path, 3).collect()]
    assert names == ["ref/._map.csv", "ref/.DS_Store", "ref/map.csv"]
    lines = archives.read_tar_lines(spark, path)
    assert {r["member"] for r in lines.collect()} == {"ref/map.csv", "ref/more.csv"}
    table = conform_abmap(archives.read_tar_csv(spark, path)).collect()
    assert {(r["customer_id"], r["is_target"]) for r in table} == {("c0", 0), ("c1", 0), ("c2", 0)}


def test_long_member_is_streamed_whole(spark, tmp_path):
    path = tmp_path / "a.tar.gz"
    with tarfile.open(path, "w:gz") as tar:
        add(tar, "big.csv", csv_text(["1"] * 45_000))
    lines = archives.read_tar_lines(spark, str(path))
    assert lines.agg(F.count("*"), F.max("line_no"), F.count_distinct("line_no")).first() == (
        45_001, 45_000, 45_001,
    )


def test_result_tables(spark, tmp_path):
    table = spark.createDataFrame([("b", 2.0), ("a", 1.0)], "segment string, v double")
    path = sinks.save_table_csv(table, str(tmp_path / "out"), "t", sort_by=["segment"])
    back = readers.read_result_csv(spark, path, "segment string, v double")
    assert back.collect() == [("a", 1.0), ("b", 2.0)]
    folder = sinks.save_segment_tables(
        {"x": table, "y": table.withColumn("segment", F.lit(True))}, str(tmp_path / "many")
    )
    assert {p.name for p in (tmp_path / "many").glob("segment_name=*")} == {
        "segment_name=x", "segment_name=y",
    }
    assert spark.read.option("header", True).csv(folder).count() == 4


def test_sharded_json_and_users(spark, tmp_path):
    df = spark.range(10).withColumnRenamed("id", "order_id")
    sinks.write_sharded_json(df, str(tmp_path / "j"), 4)
    assert len(list((tmp_path / "j").glob("part-*"))) == 4
    sinks.write_users_silver(df, str(tmp_path / "u"))
    assert spark.read.parquet(str(tmp_path / "u")).count() == 10


def test_stage_uses_the_shared_folder(spark):
    df = stage(spark.range(5), "five")
    assert df.count() == 5
    assert shared_dir(spark) in df.inputFiles()[0]
    assert "Range" not in df._jdf.queryExecution().optimizedPlan().toString()
