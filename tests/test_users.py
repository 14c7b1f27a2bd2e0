"""Fact and user table."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from trialmart.functions.columns import round_doubles
from trialmart.operators import conform, extensions, fact, users
from trialmart.plans import adapter
from trialmart.plans.silver import clean_and_conform, users_silver
from trialmart.sources.sinks import write_orders_silver
from trialmart.sources.storage import stage

SF_DIR = "/root/testdata/sf0.001"
FACT = (
    "customer_id string, order_id string, event_ts_utc timestamp, order_total_amount double, "
    "is_target int, consumer_created_at timestamp, origin_platform string, active boolean"
)


def day(n, hour=0):
    return dt.datetime(2019, 1, n, hour)


def silver(spark, *rows):
    return spark.createDataFrame(list(rows), FACT)


def test_edges_of_one_user(spark):
    table = silver(
        spark,
        ("u", "1", day(1), 10.0, None, day(1), "ios", None),
        ("u", "3", day(3), None, 1, day(1), "web", True),
        ("u", "2", day(3), 5.0, 1, day(1), "app", True),
        ("u", "4", day(9), 5.0, 1, day(1), None, True),
    )
    (row,) = users.build_user_aggregates(table, "2019-01-01", "2019-01-11").collect()
    assert row["frequency"] == 4 and row["monetary"] == 20.0 and row["heavy_user"]
    assert row["is_target"] == 1 and row["active"] is True
    # Latest event with a platform; order 3 comes after order 2 at the same time.
    assert row["origin_platform"] == "web"
    assert row["recency"] == 2 and row["is_new_customer"] is True


@pytest.mark.parametrize("created, new", [(day(1), True), (day(11), False), (None, None)])
def test_new_customer_bounds(spark, created, new):
    table = silver(spark, ("u", "1", day(2), 1.0, 1, created, "ios", True))
    (row,) = users.build_user_aggregates(table, "2019-01-01", "2019-01-11").collect()
    assert row["is_new_customer"] is new


def test_bounds_from_data(spark):
    table = silver(
        spark,
        ("u", "1", day(2, 5), 1.0, 1, day(2), "ios", True),
        ("v", "2", day(6, 7), 1.0, 0, day(1), "ios", True),
    )
    rows = {r["customer_id"]: r for r in users.build_user_aggregates(table).collect()}
    assert rows["u"]["recency"] == 5 and rows["v"]["recency"] == 1
    assert rows["u"]["is_new_customer"] and not rows["v"]["is_new_customer"]
    last = users.build_user_aggregates(table, recency_ref="last_event").collect()
    assert {r["customer_id"]: r["recency"] for r in last} == {"u": 4, "v": 0}


def test_empty_fact(spark):
    assert users.build_user_aggregates(silver(spark)).collect() == []
    assert fact.infer_window(silver(spark)).collect() == [(None, None)]
    assert fact.infer_window(silver(spark), "quantile").collect() == [(None, None)]


@pytest.mark.parametrize("null_as_control", [False, True])
@pytest.mark.parametrize("explicit", [False, True])
def test_short_and_long_way_agree(spark, null_as_control, explicit):
    raw = adapter.raw_tables(spark, SF_DIR)
    start, end = adapter.WINDOW if explicit else (None, None)
    options = {
        "treat_is_target_null_as_control": null_as_control,
        "experiment_start": start,
        "experiment_end": end,
    }
    joined = clean_and_conform(
        raw.orders, raw.consumers, raw.restaurants, raw.abmap, **options
    )
    long_way = users.build_user_aggregates(
        stage(fact.build_orders_silver(joined), "t"), start, end, recency_ref="last_event"
    )
    if explicit:
        short = users_silver(raw, recency_ref="last_event", **options)
    else:
        # Without a window the reference dates come from the users themselves.
        short = users.users_from_conformed(
            conform.conform_orders(raw.orders, columns=conform.USER_ORDER_COLUMNS).where(
                "event_ts_utc is not null"
            ),
            conform.conform_consumers(raw.consumers),
            conform.conform_abmap(raw.abmap),
            null_as_control=null_as_control,
            recency_ref="last_event",
        )
    a = round_doubles(long_way).collect()
    b = round_doubles(short.select(*long_way.columns)).collect()
    assert len(a) > 50 and sorted(a, key=str) == sorted(b, key=str)


def test_window_is_half_open(spark):
    table = silver(
        spark, *[("u", str(i), day(i), 1.0, 1, None, None, None) for i in (1, 2, 3)]
    )
    kept = fact.experiment_window(table, "2019-01-01", "2019-01-03")
    assert {r["order_id"] for r in kept.collect()} == {"1", "2"}


def test_imputation_leaves_rows_without_range(spark):
    table = spark.createDataFrame(
        [("1", 1, 10.0, None), ("2", 1, None, 4.0), ("3", None, None, 2.0), ("4", None, 8.0, None)],
        "order_id string, price_range int, minimum_order_value double, delivery_time double",
    )
    rows = {r["order_id"]: r for r in fact.impute_by_price_range(table).collect()}
    assert rows["2"]["minimum_order_value_imputed"] == 10.0
    assert rows["1"]["delivery_time_imputed"] == 4.0
    assert rows["3"]["minimum_order_value_imputed"] is None
    assert rows["4"]["delivery_time_imputed"] is None


def test_period_days_falls_back(spark):
    one = spark.createDataFrame([(day(1),)], "last_order timestamp")
    assert users.period_days(one).first()[0] == 30
    two = spark.createDataFrame([(day(1, 23),), (day(4, 1),)], "last_order timestamp")
    assert users.period_days(two).first()[0] == 3


def test_partition_dates_keep_the_window(spark, tmp_path):
    rows = [("u", str(i), day(i, 1), 1.0, 1, None, None, None) for i in range(1, 9)]
    table = silver(spark, *rows).withColumn(
        "event_date_brt", F.to_date(F.from_utc_timestamp("event_ts_utc", "America/Sao_Paulo"))
    )
    path = str(tmp_path / "silver")
    write_orders_silver(table, path)
    cut = fact.prune_event_dates(spark.read.parquet(path), "2019-01-03", "2019-01-05")
    assert {r["order_id"] for r in cut.collect()} == {"3", "4"}
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date_brt" in plan


def test_session_time_zone_does_not_matter(spark):
    """Instants, windows, days and weeks are the same in every session zone."""
    def results():
        raw = adapter.raw_tables(spark, SF_DIR)
        typed = conform.conform_orders(raw.orders, columns=conform.FACT_ORDER_COLUMNS)
        seconds = F.unix_micros("event_ts_utc")
        out = [typed.agg(
            F.count("event_ts_utc"), F.bit_xor(F.xxhash64("order_id", seconds)), F.min("event_date_brt"),
            F.bit_xor(F.xxhash64("order_id", "event_date_brt")),
        ).first()]
        out += [fact.infer_window(typed, m).first() for m in ("minmax", "quantile")]
        cut = fact.experiment_window(typed, *adapter.WINDOW)
        out.append(cut.count())
        fact_like = cut.withColumns(
            {"is_target": F.lit(1), "active": F.lit(True),
             "consumer_created_at": F.col("event_ts_utc")}
        )
        table = users.build_user_aggregates(fact_like, *adapter.WINDOW)
        late = users.recency_from_last_event(table)
        for t in (table, late):
            out.append(t.agg(F.sum("recency"), F.count_if("is_new_customer"),
                             F.bit_xor(F.xxhash64("customer_id", F.unix_micros("last_order")))).first())
        weeks = extensions.weekly_users(fact_like)
        out.append(weeks.agg(F.bit_xor(F.xxhash64("week", "customer_id")), F.count("*")).first())
        return out

    before = spark.conf.get("spark.sql.session.timeZone")
    found = []
    try:
        for zone in ("UTC", "America/Sao_Paulo", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            found.append(results())
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert found[0] == found[1] == found[2]
