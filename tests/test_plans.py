"""Shapes of the physical plans that matter on large tables."""

from __future__ import annotations

import contextlib
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from trialmart.functions.columns import keep_first
from trialmart.operators import conform, fact, quality, users
from trialmart.plans import adapter, catalog, silver

SF_DIR = entry_points.SMOKE_DIR


@contextlib.contextmanager
def conf(spark, **settings):
    names = {k.replace("__", "."): v for k, v in settings.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_no_pair_joins_and_no_gathering(spark, name):
    text = plan(catalog.queries()[name](spark, SF_DIR))
    assert "NestedLoopJoin" not in text and "CartesianProduct" not in text
    lines = [(len(x) - len(x.lstrip(" :+-")), x) for x in text.split("\n")]
    for i, (depth, line) in enumerate(lines):
        # Only partial aggregates may meet in a single task.
        if "Exchange SinglePartition" in line:
            parent = next(x for d, x in reversed(lines[:i]) if d < depth)
            assert "Aggregate" in parent, parent
    assert not re.search(r"functions=\[[^\]]*(collect_list|percentile\()", text)


def test_dedup_is_limited_before_the_shuffle(spark):
    text = plan(conform.conform_orders(adapter.raw_tables(spark, SF_DIR).orders))
    partial, exchange = text.index("row_number(), 1, Partial"), text.index("Exchange hashpart")
    assert text.index("row_number(), 1, Final") < exchange < partial


def test_users_fold_orders_before_any_join(spark):
    with conf(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        text = plan(silver.users_silver(
            adapter.raw_tables(spark, SF_DIR), experiment_start=adapter.WINDOW[0],
            experiment_end=adapter.WINDOW[1],
        ))
    # One shuffle of orders to deduplicate, one to fold; one per small table.
    assert text.count("Exchange hashpartitioning(customer_id") == 3
    assert text.count("Exchange hashpartitioning(order_id") == 1
    assert "partial_count(1)" in text and "supplier" not in text


def test_unused_columns_are_not_read(spark):
    text = plan(catalog.queries()["ab_summary"](spark, SF_DIR))
    (schema,) = set(re.findall(r"ReadSchema: (struct<[^>]*>)", text))
    assert schema == "struct<customer_id:string,frequency:bigint,monetary:double,is_target:int>"


@pytest.mark.parametrize("null_as_control", [False, True])
def test_hot_customer_is_split(spark, null_as_control):
    n = 40_000
    orders = spark.range(n).select(
        F.col("id").cast("string").alias("order_id"),
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id"))).alias(
            "customer_id"
        ),
        F.when(F.col("id") % 3 > 0, "m1").alias("merchant_id"),
        F.sha2(F.col("id").cast("string"), 256).alias("origin_platform"),
    )
    people = orders.select("customer_id").distinct()
    consumers = people.select("customer_id", F.lit("pt").alias("language"))
    abmap = people.select("customer_id", F.lit(1).alias("is_target"))
    places = spark.createDataFrame([("m1", 3)], "merchant_id string, price_range int")
    places = keep_first(places, ["merchant_id"], ["price_range"])
    with conf(
        spark,
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="100KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.2",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="64KB",
    ):
        joined = fact.join_fact(
            orders.repartition(8), consumers, places, abmap, null_as_control
        )
        assert joined.where("customer_id = 'hot'").count() == n // 2
        assert joined.agg(F.count("*"), F.count("price_range")).first() == (n, n - 13_334)
        done = joined.groupBy("language").agg(F.max("origin_platform"), F.sum("price_range"))
        done.collect()
        # Both the customer and the merchant join.
        assert plan(done).count("SortMergeJoin(skew=true)") == 2


def test_hot_customer_in_user_table(spark):
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 7)).alias(
            "customer_id"
        ),
        F.col("id").cast("string").alias("order_id"),
        F.timestamp_seconds(F.col("id")).alias("event_ts_utc"),
        F.lit(1.0).alias("order_total_amount"),
        F.lit(1).alias("is_target"),
        F.lit(None).cast("timestamp").alias("consumer_created_at"),
        F.when(F.col("id") == 29_997, "last").when(F.col("id") < 100, "first").alias(
            "origin_platform"
        ),
        F.lit(True).alias("active"),
    )
    table = users.build_user_aggregates(rows, "1970-01-01", "1970-01-02")
    hot = table.where("customer_id = 'hot'").first()
    assert (hot["frequency"], hot["monetary"], hot["origin_platform"]) == (10_000, 10_000.0, "last")


def test_silver_join_takes_stored_means_by_size(spark):
    silver, means = catalog.silver_orders(spark, SF_DIR), catalog._means(spark, SF_DIR)
    assert "BroadcastHashJoin" in plan(fact.impute_by_price_range(silver, means))
    with conf(spark, spark__sql__autoBroadcastJoinThreshold="10"):
        assert "SortMergeJoin" in plan(fact.impute_by_price_range(silver, means))


def test_duplicate_groups_count_without_gathering(spark):
    text = plan(quality.duplicate_groups(catalog.silver_orders(spark, SF_DIR), ids_unique=True))
    assert text.count("Exchange hashpartitioning") == 1 and "collect" not in text


def test_folded_values_are_shuffled_once(spark):
    df = catalog.queries()["ab_robust"](spark, SF_DIR)
    df.collect()
    text = plan(df).split("== Initial Plan ==")[0]
    assert "ReusedExchange" in text and "percentile_approx" not in text


def test_post_etl_checks(spark):
    silver_rows, table = catalog.silver_orders(spark, SF_DIR), catalog.silver_users(spark, SF_DIR)
    checks = quality.check_post_etl(silver_rows, table, light=False)
    assert set(checks) == {
        "time_range", "ab_split", "null_counts", "duplicate_total", "worst_duplicates",
        "worst_duplicate_members", "preview_orders", "preview_users",
    }
    assert checks["null_counts"].count() == len(silver_rows.columns)
    assert checks["ab_split"].agg(F.sum("n_users")).first()[0] == table.count()
    for check in checks.values():
        check.collect()


def test_staged_tables_follow_their_source(spark, tmp_path):
    import shutil

    for name in ("orders", "lineitem", "customer", "supplier"):
        shutil.copyfile(f"{SF_DIR}/{name}.parquet", tmp_path / f"{name}.parquet")
    first = catalog.silver_users(spark, str(tmp_path))
    assert catalog.silver_users(spark, str(tmp_path)) is first
    spark.read.parquet(f"{SF_DIR}/customer.parquet").limit(20).toPandas().to_parquet(
        tmp_path / "customer.parquet"
    )
    assert catalog.silver_users(spark, str(tmp_path)).count() < first.count()


def test_folders_made_inside_are_known_and_can_go(spark):
    from trialmart.sources.storage import drop_folders, folders_made, stage

    kept = stage(spark.range(3), "kept")
    with folders_made() as outer:
        first = stage(spark.range(4), "outer")
        with folders_made() as inner:
            second = stage(spark.range(5), "inner")
    assert len(outer) == len(inner) == 1 and outer != inner
    drop_folders(spark, [*inner, *inner])
    assert kept.count() == 3 and first.count() == 4
    with pytest.raises(Exception):
        second.count()
