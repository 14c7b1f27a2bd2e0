"""Edges of the conform step."""

from __future__ import annotations

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from trialmart.functions.fixed_values import TIMESTAMP_FORMATS
from trialmart.functions.timestamps import parse_timestamp
from trialmart.operators.conform import (
    FACT_ORDER_COLUMNS,
    USER_ORDER_COLUMNS,
    arm_from_label,
    basket_size,
    conform_abmap,
    conform_consumers,
    conform_orders,
    conform_restaurants,
)

ORDER = (
    "order_id string, customer_id string, merchant_id string, order_created_at string, "
    "order_scheduled boolean, order_scheduled_date string, order_total_amount double, "
    "origin_platform string, merchant_timezone string, items string, cpf string, "
    "customer_name string"
)


def order(oid="1", cid="c", created="2019-01-01 10:00:00", scheduled=None, at=None, amount=10.0,
          platform="IOS", tz="UTC", items=None):
    return (oid, cid, "m", created, scheduled, at, amount, platform, tz, items, "123", "Ana")


def conformed(spark, *rows, **options):
    return conform_orders(spark.createDataFrame(list(rows), ORDER), **options).collect()


def test_null_amount_stays_negative_goes(spark):
    rows = conformed(spark, order("1", amount=None), order("2", amount=-1.0), order("3"))
    assert {r["order_id"] for r in rows} == {"1", "3"}


def test_negative_first_copy_hides_the_later_one(spark):
    # Copies are removed before the amount is checked.
    rows = conformed(
        spark, order(amount=-1.0, created="2019-01-01"), order(amount=5.0, created="2019-01-02")
    )
    assert rows == []


def test_missing_keys_go(spark):
    assert conformed(spark, order(oid=None), order(cid=None)) == []


def test_scheduled_before_creation_is_ignored(spark):
    (row,) = conformed(spark, order(scheduled=True, at="2018-12-31 09:00:00"))
    assert row["event_ts_utc"] == dt.datetime(2019, 1, 1, 10)


def test_scheduled_after_creation_counts(spark):
    (row,) = conformed(spark, order(scheduled=True, at="2019-01-02 01:00:00"))
    assert row["event_ts_utc"] == dt.datetime(2019, 1, 2, 1)
    assert row["event_date_brt"] == dt.date(2019, 1, 1)


def test_offset_is_shifted_twice_unless_asked(spark):
    text = "2019-06-01T10:00:00Z"
    (kept,) = conformed(spark, order(created=text, tz="America/Manaus"))
    (aware,) = conformed(spark, order(created=text, tz="America/Manaus"), offset_aware=True)
    assert kept["event_ts_utc"] == dt.datetime(2019, 6, 1, 14)
    assert aware["event_ts_utc"] == dt.datetime(2019, 6, 1, 10)


def test_pii_is_gone(spark):
    (row,) = conformed(spark, order())
    assert row["cpf_hash"] == hashlib.sha256(b"123").hexdigest()
    assert not {"cpf", "customer_name"} & set(row.asDict())


def test_sparse_input_gets_typed_nulls(spark):
    raw = spark.createDataFrame([(1, 2)], "order_id long, customer_id long")
    df = conform_orders(raw)
    types = dict(df.dtypes)
    assert types["order_id"] == "string" and types["order_total_amount"] == "double"
    assert types["order_created_at"] == "timestamp" and types["basket_size"] == "int"
    assert df.count() == 1


def test_narrow_columns_choose_the_same_copy(spark):
    rows = [order(amount=a, platform=p) for a in (3.0, 1.0, 2.0) for p in ("b", "a")]
    raw = spark.createDataFrame(rows, ORDER).repartition(3)
    full = conform_orders(raw)
    for columns in (USER_ORDER_COLUMNS, FACT_ORDER_COLUMNS):
        slim = conform_orders(raw, columns=columns)
        assert slim.collect() == full.select(*slim.columns).collect()


@pytest.mark.parametrize("partitions", [1, 2, 7])
def test_dedup_ignores_partitioning(spark, partitions):
    rows = [order(str(i % 5), amount=float(i)) for i in range(50)]
    raw = spark.createDataFrame(rows, ORDER).repartition(partitions)
    got = {(r["order_id"], r["order_total_amount"]) for r in conform_orders(raw).collect()}
    assert got == {(str(i), float(i)) for i in range(5)}


@pytest.mark.parametrize(
    "text, size",
    [('[{"a":"1"},{"b":"2"}]', 2), ("  []", 0), ("[bad", None), ("oops", None), (None, None)],
)
def test_basket_from_text(spark, text, size):
    df = spark.createDataFrame([(text,)], "items string")
    assert df.select(basket_size(df)).first()[0] == size


def test_basket_from_array(spark):
    df = spark.createDataFrame([([("a",)],), (None,)], "items array<struct<x:string>>")
    assert [r[0] for r in df.select(basket_size(df)).collect()] == [1, None]


def test_fast_parser_agrees_with_the_patterns(spark):
    texts = [
        "2019-01-02T03:04:05.678Z", "2019-01-02T03:04:05Z", "2019-01-02T03:04:05-03",
        "2019-01-02T03:04:05-0300", "2019-01-02T03:04:05.678-03:00", "2019-01-02 03:04:05",
        "2019-01-02", "2019-01-02 03:04:05.5", "2019-1-2", "02/01/2019", "not-a-date", "", None,
        "2019-13-01", "2019-02-30", "2019-01-02T25:00:00Z", " 2019-01-02 ",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    patterns = [F.try_to_timestamp("s", F.lit(f)) for f in TIMESTAMP_FORMATS]
    slow = F.coalesce(*patterns, F.try_to_timestamp("s"))
    rows = df.select("s", parse_timestamp(F.col("s")).alias("a"), slow.alias("b")).collect()
    assert [r for r in rows if r["a"] != r["b"]] == []
    assert sum(r["a"] is not None for r in rows) >= 9


def test_empty_phone_is_hash_of_nothing(spark):
    raw = spark.createDataFrame(
        [("1", "PT", None, None, None, None)],
        "customer_id string, language string, created_at string, active string, "
        "customer_phone_area string, customer_phone_number string",
    )
    row = conform_consumers(raw).first()
    assert row["phone_hash"] == hashlib.sha256(b"").hexdigest()
    assert row["language"] == "pt" and row["active"] is None


def test_consumer_copies_keep_the_earliest(spark):
    raw = spark.createDataFrame(
        [("1", "b", "2019-01-02"), ("1", "a", "2019-01-01"), ("1", "c", None)],
        "customer_id string, language string, created_at string",
    )
    assert [r["language"] for r in conform_consumers(raw).collect()] == ["a"]


def test_restaurant_figures(spark):
    raw = spark.createDataFrame(
        [("9", "true", "x", "-1", "30", "oops", 7)],
        "id string, enabled string, price_range string, average_ticket string, "
        "delivery_time string, minimum_order_value string, merchant_zip_code int",
    )
    row = conform_restaurants(raw).first()
    assert (row["price_range"], row["average_ticket"], row["minimum_order_value"]) == (None,) * 3
    assert row["delivery_time"] == 30.0 and row["merchant_zip_code"] == "7"


def test_labels(spark):
    labels = ["Treatment", "TESTE", "b", "1", "true", "controle", "A", "0", "False", "x", "7", None]
    df = spark.createDataFrame([(v,) for v in labels], "g string")
    got = [r[0] for r in df.select(arm_from_label(F.col("g"))).collect()]
    assert got == [1, 1, 1, 1, 1, 0, 0, 0, 0, None, 7, None]


def test_abmap_headers_and_copies(spark):
    raw = spark.createDataFrame([(1, "b"), (1, "a"), (2, "b")], ["Customer ID", " AB Group "])
    rows = conform_abmap(raw.withColumnRenamed("Customer ID", " Customer ID")).collect()
    assert {(r["customer_id"], r["is_target"]) for r in rows} == {("1", 0), ("2", 1)}


def test_abmap_without_group_column(spark):
    with pytest.raises(ValueError, match="arm"):
        conform_abmap(spark.createDataFrame([("1", "b")], ["customer_id", "colour"]))
