"""Named queries over a folder of tables.

Silver tables are built once per session and folder and kept as Parquet in the
shared folder; the queries on users and on the order fact read those. Double
columns are rounded to six digits, as the order of summation is not fixed.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import keep_first, round_doubles, with_user_metrics
from ..functions.fixed_values import EXTRACTED_AB_DIR, REQUIRED_FILES
from ..functions.timestamps import parse_timestamp
from ..operators import (
    charts,
    conform,
    extensions,
    fact,
    finance,
    quality,
    reshape,
    sampling,
    segments,
    significance,
    sketches,
    summary,
    user_state,
    users,
)
from ..sources import archives, days, files, gzip_index, manifest, readers, sinks
from ..sources.byte_access import locate
from ..sources.storage import new_folder, stage
from .adapter import WINDOW, raw_tables
from .silver import clean_and_conform, users_silver

Query = Callable[[SparkSession, str], DataFrame]

_STAGED: dict[tuple[str, str, str, int], DataFrame] = {}
_CATALOG: dict[str, Query] = {}


def _query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return round_doubles(fn(spark, sf_dir))

    _CATALOG[fn.__name__] = run
    return fn


def queries() -> dict[str, Query]:
    return dict(_CATALOG)


# Of the files that queries write and read again, so that each is read in several chunks.
_SMALL_CHUNKS = 1 << 18

_SOURCES = ("orders", "lineitem", "customer", "supplier")


def _files(spark: SparkSession, sf_dir: str, name: str) -> list[tuple[str, int, int]]:
    """Names, sizes and times of the files of a table."""
    jvm = spark.sparkContext._jvm
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{name}.parquet")
    found = path.getFileSystem(conf).listStatus(path)
    return [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in found]


def _state(spark: SparkSession, sf_dir: str) -> int:
    """Names, sizes and times of the source files; another value once they change."""
    return hash(tuple(sorted(f for name in _SOURCES for f in _files(spark, sf_dir, name))))


_PARQUET_BYTES = 4 << 20


def _parts(spark: SparkSession, sf_dir: str, name: str, least: int) -> int:
    """How many tasks write the raw rows of a table: more of them as its files grow."""
    size = sum(f[1] for f in _files(spark, sf_dir, name))
    return max(least, -(-size // _PARQUET_BYTES))


def _staged(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table staged once for the session, the folder and the state of its files."""
    key = (spark.sparkContext.applicationId, sf_dir, name, _state(spark, sf_dir))
    if key not in _STAGED:
        _STAGED[key] = stage(build(), name)
    return _STAGED[key]


def typed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conformed orders, not cut to the window."""
    raw = raw_tables(spark, sf_dir)
    return conform.conform_orders(raw.orders, columns=conform.FACT_ORDER_COLUMNS)


def silver_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order fact inside the experiment window."""
    raw = raw_tables(spark, sf_dir)
    return _staged(
        spark, sf_dir, "orders_silver",
        lambda: fact.build_orders_silver(
            clean_and_conform(
                raw.orders, raw.consumers, raw.restaurants, raw.abmap,
                experiment_start=WINDOW[0], experiment_end=WINDOW[1], silver_only=True,
            )
        ),
    )


def silver_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user table, built without the order fact; recency to the window end."""
    return _staged(
        spark, sf_dir, "users_silver",
        lambda: users_silver(
            raw_tables(spark, sf_dir), experiment_start=WINDOW[0], experiment_end=WINDOW[1]
        ),
    )


def scored_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with RFM scores, recency to the last event."""
    return _staged(
        spark, sf_dir, "users_rfm",
        lambda: segments.build_rfm_buckets(
            users.recency_from_last_event(silver_users(spark, sf_dir))
        ),
    )


# ---- conform -----------------------------------------------------------------


@_query
def parse_timestamps(spark, sf_dir):
    orders = raw_tables(spark, sf_dir).orders
    return orders.select(
        "order_id",
        "order_created_at",
        parse_timestamp(F.col("order_created_at")).alias("created"),
        parse_timestamp(F.col("order_scheduled_date")).alias("scheduled"),
    )


@_query
def utc_normalize(spark, sf_dir):
    timed = conform.parse_order_times(raw_tables(spark, sf_dir).orders)
    return timed.select(
        "order_id", "merchant_timezone", "order_created_at", "created_utc", "scheduled_utc"
    )


@_query
def event_time(spark, sf_dir):
    timed = conform.parse_order_times(raw_tables(spark, sf_dir).orders)
    return timed.select("order_id", "order_scheduled", "event_ts_utc", "event_date_brt")


@_query
def basket_size(spark, sf_dir):
    orders = raw_tables(spark, sf_dir).orders
    return orders.select("order_id", conform.basket_size(orders).alias("basket_size"))


@_query
def pii_hash(spark, sf_dir):
    orders = raw_tables(spark, sf_dir).orders.select(
        "order_id", "order_total_amount", "cpf", "customer_name"
    )
    return conform.hash_order_pii(orders)


@_query
def conform_orders(spark, sf_dir):
    return conform.conform_orders(raw_tables(spark, sf_dir).orders)


@_query
def dedup_orders(spark, sf_dir):
    orders = raw_tables(spark, sf_dir).orders.select(
        "order_id", "order_total_amount",
        parse_timestamp(F.col("order_created_at")).alias("created"),
    )
    return keep_first(orders, ["order_id"], ["created", "order_total_amount"])


@_query
def conform_consumers(spark, sf_dir):
    return conform.conform_consumers(raw_tables(spark, sf_dir).consumers)


@_query
def conform_restaurants(spark, sf_dir):
    return conform.conform_restaurants(raw_tables(spark, sf_dir).restaurants)


@_query
def conform_abmap(spark, sf_dir):
    return conform.conform_abmap(raw_tables(spark, sf_dir).abmap)


# ---- sources and sinks ---------------------------------------------------------


def _raw_folder(spark: SparkSession, sf_dir: str, name: str) -> str:
    return f"{new_folder(spark, 'round-trip')}/{name}"


_RAW_ORDER_TEXT = (
    "order_id", "customer_id", "merchant_id", "order_created_at", "order_scheduled",
    "origin_platform", "items", "cpf",
)


@_query
def orders_from_json_shards(spark, sf_dir):
    """Raw orders written as JSON in shards and read back whole (SNK1, SRC2, SRC4)."""
    path = _raw_folder(spark, sf_dir, "orders_sharded")
    sinks.write_sharded_json(raw_tables(spark, sf_dir).orders, path, 4)
    back = readers.read_orders(spark, path.rpartition("/")[0])
    return back.select(*_RAW_ORDER_TEXT)


@_query
def orders_from_json_array(spark, sf_dir):
    """Raw orders written as JSON arrays, read back in chunks (SRC3)."""
    path = _raw_folder(spark, sf_dir, "orders_array")
    sinks.write_json_arrays(raw_tables(spark, sf_dir).orders, path, _parts(spark, sf_dir, "orders", 2))
    back = readers.read_orders_json(spark, path, json_array=True, chunk_bytes=_SMALL_CHUNKS)
    return back.select(*_RAW_ORDER_TEXT)


@_query
def orders_from_gzip_array(spark, sf_dir):
    """The same from gzip files, entered at the places of their index (SRC3, SRC12)."""
    path = _raw_folder(spark, sf_dir, "orders_array_gz")
    sinks.write_json_arrays(raw_tables(spark, sf_dir).orders, path, _parts(spark, sf_dir, "orders", 2), "gzip")
    back = readers.read_orders_json(
        spark, path, json_array=True, index_dir=_raw_folder(spark, sf_dir, "index"),
        chunk_bytes=_SMALL_CHUNKS,
    )
    return back.select(*_RAW_ORDER_TEXT)


@_query
def orders_from_gzip_lines(spark, sf_dir):
    """Raw orders as gzip JSON lines, each file read by many tasks (SRC12, SRC2)."""
    path = _raw_folder(spark, sf_dir, "orders_gz")
    rows = raw_tables(spark, sf_dir).orders.repartition(_parts(spark, sf_dir, "orders", 2))
    rows.write.option("compression", "gzip").json(path)
    lines = gzip_index.read_lines(
        spark, path, index_dir=_raw_folder(spark, sf_dir, "index"), chunk_bytes=_SMALL_CHUNKS
    )
    row = F.from_json("value", readers.orders_schema())
    return lines.select(row.alias("row")).select("row.*").select(*_RAW_ORDER_TEXT)


@_query
def consumers_from_csv(spark, sf_dir):
    """Raw customers written as CSV, read back and conformed (SRC5)."""
    path = _raw_folder(spark, sf_dir, "consumers")
    raw_tables(spark, sf_dir).consumers.write.option("header", True).csv(path)
    return conform.conform_consumers(readers.read_csv(spark, path))


@_query
def abmap_from_folder(spark, sf_dir):
    """The assignment map written as many CSVs, read as one folder and conformed (SRC6)."""
    path = _raw_folder(spark, sf_dir, "maps")
    raw_tables(spark, sf_dir).abmap.repartition(5).write.option("header", True).csv(path)
    return conform.conform_abmap(readers.read_abmap(spark, path))


@_query
def abmap_mixed_headers(spark, sf_dir):
    """The assignment map in files with other orders of columns and one column more, by name (SRC6)."""
    path = _raw_folder(spark, sf_dir, "maps")
    rows = raw_tables(spark, sf_dir).abmap
    even = F.pmod(F.crc32("customer_id"), F.lit(2)) == 0
    rows.where(even).repartition(2).write.option("header", True).csv(f"{path}/one")
    turned = rows.where(~even).select(F.lit("x").alias("note"), "ab_group", "customer_id")
    turned.repartition(2).write.option("header", True).csv(f"{path}/two")
    return conform.conform_abmap(readers.read_abmap(spark, path, by_name=True).drop("note"))


@_query
def raw_manifest(spark, sf_dir):
    """Files, whole ones and lines of each kind of raw file, read to the end (SRC8, SRC9)."""
    raw = raw_tables(spark, sf_dir)
    path = _raw_folder(spark, sf_dir, "raw")
    for name, table, n, kind in (("orders", "orders", 3, "json"), ("consumers", "customer", 2, "csv")):
        names = [f"part-{i}.{kind}.gz" for i in range(n)]
        sinks.write_gzip_files(getattr(raw, name), f"{path}/{name}", names, kind, _parts(spark, sf_dir, table, n))
    raw.abmap.repartition(2).write.csv(f"{path}/abmap")
    found = manifest.file_manifest(spark, path).withColumn("raw", F.element_at(F.split("path", "/"), -2))
    return found.groupBy("raw", "kind").agg(
        F.count("*").alias("n_files"), F.count_if("ok").alias("n_whole"), F.sum("lines").alias("n_lines")
    )


def raw_folder(spark: SparkSession, sf_dir: str) -> str:
    """A raw folder as the loader expects it, from the tables at hand."""
    raw, path = raw_tables(spark, sf_dir), _raw_folder(spark, sf_dir, "raw")
    for name, table, kind in (("orders", "orders", "json"), ("consumers", "customer", "csv"), ("restaurants", "supplier", "csv")):
        parts = _parts(spark, sf_dir, table, 1)
        sinks.write_gzip_files(
            getattr(raw, name), path, [REQUIRED_FILES[name]], kind, parts, header=kind == "csv"
        )
    maps = f"{path}/{EXTRACTED_AB_DIR}"
    raw.abmap.repartition(4).write.option("header", True).csv(maps)
    sinks.write_tar_csv(raw.abmap, f"{path}/_tar", 1, compression="gz")
    store, top = locate(path)
    archive = store.get_file_info(fs.FileSelector(f"{top}/_tar"))[0].path
    store.move(archive, f"{top}/{REQUIRED_FILES['ab_tar']}")
    return path


@_query
def load_raw_folder(spark, sf_dir):
    """Rows and customers of the four raw tables, loaded after the preflight (SRC1, SRC8)."""
    raw = readers.load_raw(spark, raw_folder(spark, sf_dir))
    keys = {"orders": "order_id", "consumers": "customer_id", "restaurants": "id", "abmap": "customer_id"}
    counted = [
        df.agg(F.lit(name).alias("raw"), F.count("*").alias("n_rows"), F.count_distinct(keys[name]).alias("n_keys"))
        for name, df in raw.items()
    ]
    return reduce(DataFrame.unionByName, counted)


@_query
def preflight_report(spark, sf_dir):
    """Presence, lines and format of the required files (SRC7, SRC8, SRC9, SRC10)."""
    path = raw_folder(spark, sf_dir)
    report = files.preflight(spark, path)
    maps = files.list_valid_ab_csvs(spark, f"{path}/{EXTRACTED_AB_DIR}").count()
    return report.select(
        "key", "exists", "lines_read", "problem", F.lit(maps).cast("long").alias("n_maps"),
        F.lit(files.sniff_orders_format(spark, f"{path}/{REQUIRED_FILES['orders']}")).alias("orders_format"),
    )


@_query
def abmap_from_tar(spark, sf_dir):
    """The assignment map written as CSV members of gzip archives, read in chunks and conformed (SRC11)."""
    path = _raw_folder(spark, sf_dir, "archives")
    sinks.write_tar_csv(raw_tables(spark, sf_dir).abmap, path, 3, rows_per_member=2000, compression="gz")
    return conform.conform_abmap(archives.read_tar_csv(spark, path, chunk_bytes=_SMALL_CHUNKS))


@_query
def tar_lines(spark, sf_dir):
    """Numbered lines of the members of plain archives, by the key in front (SRC11)."""
    path = _raw_folder(spark, sf_dir, "archives")
    sinks.write_tar_csv(raw_tables(spark, sf_dir).abmap, path, 2, rows_per_member=2000)
    lines = archives.read_tar_lines(spark, path, chunk_bytes=1 << 14).where("line_no > 0")
    return lines.select(F.substring_index("line", ",", 1).alias("customer_id"))


@_query
def silver_by_date(spark, sf_dir):
    """The order fact stored by day and read back for a part of the window (SNK2)."""
    path = _raw_folder(spark, sf_dir, "silver")
    sinks.write_orders_silver(silver_orders(spark, sf_dir), path)
    cut = fact.prune_event_dates(spark.read.parquet(path), "1997-06-01", "1997-09-01")
    return cut.select("order_id", "event_ts_utc", "order_total_amount")


@_query
def silver_days_replaced(spark, sf_dir):
    """The order fact by day, some days written wrong first and then replaced (SNK2)."""
    path = _raw_folder(spark, sf_dir, "days")
    orders = silver_orders(spark, sf_dir).select("order_id", "event_ts_utc", "order_total_amount", days.DAY)
    late = F.col(days.DAY) >= F.lit("1997-06-01").cast("date")
    wrong = orders.withColumn("order_total_amount", F.when(late, -1.0).otherwise(F.col("order_total_amount")))
    days.replace_days(wrong, path)
    days.replace_days(orders.where(late), path)
    return days.read_days(spark, path).drop(days.DAY)


@_query
def users_folded(spark, sf_dir):
    """The user table from three batches of raw orders, copies spread over them (AGG3, AGG5)."""
    raw = raw_tables(spark, sf_dir)
    state = user_state.UserState(spark, _raw_folder(spark, sf_dir, "state"), *WINDOW)
    batch = F.pmod(F.crc32(F.concat_ws("|", "order_id", "order_created_at", F.col("order_total_amount").cast("string"))), F.lit(3))
    for number in range(3):
        state.fold(raw.orders.where(batch == number))
    return users.users_from_totals(
        state.totals(), conform.conform_consumers(raw.consumers), conform.conform_abmap(raw.abmap), *WINDOW
    )


@_query
def robust_from_sketches(spark, sf_dir):
    """Medians and tails from stored sketches; whether their ranks keep to the bound (AGG10)."""
    known = silver_users(spark, sf_dir)
    stored = stage(sketches.quantile_sketches(known, ["is_target", "origin_platform"]), "quantile_sketches")
    probs = {"median": 0.5, "p95": 0.95}
    found = stage(sketches.quantiles(sketches.merge_quantiles(stored, ["is_target"]), probs), "sketch_quantiles")
    values = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in _CHART_METRICS]
    long = with_user_metrics(known).select("is_target", F.inline(F.array(*values)))
    # An arm and metric have one row; a NULL arm is a group like the others.
    arm = F.coalesce(F.col("is_target").cast("int"), F.lit(-1))
    ranked = long.withColumn("arm", arm).join(
        F.broadcast(found.withColumn("arm", arm).drop("is_target")), ["arm", "metric"]
    ).groupBy("is_target", "metric", "n", "rank_error").agg(
        *[F.count_if(F.col("value") < F.col(c)).alias(f"{c}_below") for c in probs],
        *[F.count_if(F.col("value") <= F.col(c)).alias(f"{c}_upto") for c in probs],
    )
    kept = [
        ((F.col(f"{c}_below") <= (p + F.col("rank_error")) * F.col("n"))
         & (F.col(f"{c}_upto") >= (p - F.col("rank_error")) * F.col("n"))).alias(f"{c}_in_bound")
        for c, p in probs.items()
    ]
    return ranked.select("is_target", "metric", "n", *kept)


@_query
def distinct_users_from_sketches(spark, sf_dir):
    """Customers of each platform over all days from stored sketches, within the bound (AGG12)."""
    rows = silver_orders(spark, sf_dir)
    stored = stage(sketches.user_sketches(rows, [days.DAY, "origin_platform"]), "user_sketches")
    found = sketches.distinct_users(sketches.merge_users(stored, ["origin_platform"]))
    exact = rows.groupBy("origin_platform").agg(F.count_distinct("customer_id").alias("n_exact"))
    both = exact.join(found, exact["origin_platform"].eqNullSafe(found["origin_platform"]))
    near = F.abs(F.col("n_users") - F.col("n_exact")) <= F.col("error")
    return both.select(exact["origin_platform"], "n_exact", near.alias("in_bound"))


@_query
def shared_users_from_sketches(spark, sf_dir):
    """Customers of two platforms from stored sketches, within the bound (SRT2)."""
    rows = silver_orders(spark, sf_dir)
    stored = stage(sketches.user_sketches(rows, [days.DAY, "origin_platform"]), "user_sketches")
    found = sketches.shared_users(stored, "origin_platform", ["android", "ios"])
    flags = [F.max(F.col("origin_platform") == p).alias(p) for p in ("android", "ios")]
    exact = rows.groupBy("customer_id").agg(*flags).agg(
        F.count_if(F.col("android") & F.col("ios")).alias("n_both"),
        F.count_if(F.col("android") | F.col("ios")).alias("n_either"),
    )
    told = exact.withColumn("found", found.select(F.struct("*")).scalar())
    error = F.col("found.error")
    return told.select(
        "n_both", "n_either",
        (F.abs(F.col("found.n_all") - F.col("n_both")) <= error).alias("both_in_bound"),
        (F.abs(F.col("found.n_any") - F.col("n_either")) <= error).alias("either_in_bound"),
    )


@_query
def break_even_from_csv(spark, sf_dir):
    """A result table written as CSV and read back (SNK4, SRC13)."""
    table = _break_even(spark, sf_dir, "origin_platform").select("segment", "usuarios_trat", "status")
    folder = new_folder(spark, "round-trip")
    path = sinks.save_table_csv(table, folder, "break_even", sort_by=["segment"])
    return readers.read_result_csv(spark, path, "segment string, usuarios_trat long, status string")


# ---- fact --------------------------------------------------------------------


@_query
def infer_window_minmax(spark, sf_dir):
    return fact.infer_window(typed_orders(spark, sf_dir), "minmax")


@_query
def infer_window_quantile(spark, sf_dir):
    return fact.infer_window(typed_orders(spark, sf_dir), "quantile")


@_query
def experiment_window(spark, sf_dir):
    cut = fact.experiment_window(typed_orders(spark, sf_dir), *WINDOW)
    return cut.select("order_id", "event_ts_utc", "order_total_amount")


@_query
def fact_join(spark, sf_dir):
    raw = raw_tables(spark, sf_dir)
    joined = clean_and_conform(
        raw.orders, raw.consumers, raw.restaurants, raw.abmap, silver_only=True,
        use_quantile_window=True,
    )
    return joined.select(
        "order_id", "customer_id", "merchant_id", "event_ts_utc", "is_target", "language",
        "phone_hash", "price_range", "merchant_city",
    )


@_query
def assignment_policy(spark, sf_dir):
    raw = raw_tables(spark, sf_dir)
    joined = clean_and_conform(
        raw.orders, raw.consumers, raw.restaurants, raw.abmap, silver_only=True,
        experiment_start=WINDOW[0], experiment_end=WINDOW[1],
        treat_is_target_null_as_control=True,
    )
    return joined.groupBy("is_target").agg(
        F.count("*").alias("n_orders"), F.sum("order_total_amount").alias("gmv")
    )


@_query
def orders_silver(spark, sf_dir):
    raw = raw_tables(spark, sf_dir)
    return fact.build_orders_silver(
        clean_and_conform(
            raw.orders, raw.consumers, raw.restaurants, raw.abmap, silver_only=True,
            experiment_start=WINDOW[0], experiment_end=WINDOW[1],
        )
    )


def _means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _staged(
        spark, sf_dir, "price_range_means",
        lambda: fact.price_range_means(silver_orders(spark, sf_dir)),
    )


@_query
def enrich_orders(spark, sf_dir):
    enriched = fact.enrich_orders_for_analysis(
        silver_orders(spark, sf_dir), _means(spark, sf_dir)
    )
    return enriched.select(
        "order_id", "origin_platform_clean", "language_clean", "active_clean",
        "minimum_order_value_imputed", "delivery_time_imputed",
    )


@_query
def impute_by_range(spark, sf_dir):
    filled = fact.impute_by_price_range(silver_orders(spark, sf_dir), _means(spark, sf_dir))
    return filled.select(
        "order_id", "price_range", "minimum_order_value", "minimum_order_value_imputed",
        "delivery_time", "delivery_time_imputed",
    )


# ---- users -------------------------------------------------------------------


@_query
def user_aggregates(spark, sf_dir):
    return users.build_user_aggregates(silver_orders(spark, sf_dir), *WINDOW)


@_query
def users_from_raw(spark, sf_dir):
    return users_silver(
        raw_tables(spark, sf_dir), experiment_start=WINDOW[0], experiment_end=WINDOW[1]
    )


@_query
def recency_last_event(spark, sf_dir):
    table = users.recency_from_last_event(silver_users(spark, sf_dir))
    return table.select("customer_id", "last_order", "recency")


@_query
def orders_per_customer(spark, sf_dir):
    return users.orders_per_customer(typed_orders(spark, sf_dir))


@_query
def user_metrics(spark, sf_dir):
    return with_user_metrics(silver_users(spark, sf_dir)).select(
        "customer_id", "is_target", "frequency", "monetary", "aov_user", "conv_flag"
    )


@_query
def period_days(spark, sf_dir):
    return users.period_days(silver_users(spark, sf_dir))


# ---- summaries ---------------------------------------------------------------


@_query
def ab_summary(spark, sf_dir):
    return summary.compute_ab_summary(silver_users(spark, sf_dir), ids_unique=True)


@_query
def ab_robust(spark, sf_dir):
    return summary.compute_robust_metrics(silver_users(spark, sf_dir), ids_unique=True)


@_query
def ab_robust_exact(spark, sf_dir):
    return summary.compute_robust_metrics(
        silver_users(spark, sf_dir), method="cont", ids_unique=True
    )


def _by_segment(column: str, **options) -> Query:
    def run(spark, sf_dir):
        table = scored_users(spark, sf_dir)
        return summary.ab_metrics_by_segment(
            table, segment_col=column, ids_unique=True, **options
        )

    return run


def _robust_by(column: str, method: str = "disc") -> Query:
    def run(spark, sf_dir):
        return summary.robust_metrics_by_segment(
            scored_users(spark, sf_dir), segment_col=column, method=method, ids_unique=True
        )

    return run


def _register(name: str, fn: Query) -> None:
    def named(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(spark, sf_dir)

    named.__name__ = name
    _query(named)


_register("ab_by_heavy", _by_segment("heavy_user"))
_register("ab_by_new", _by_segment("is_new_customer"))
_register("ab_by_platform", _by_segment("origin_platform"))
_register("ab_by_rfm_top10", _by_segment("rfm_segment", top_k_segments=10))
_register("robust_by_heavy", _robust_by("heavy_user"))
_register("robust_by_new", _robust_by("is_new_customer"))
_register("robust_by_platform", _robust_by("origin_platform"))
_register("robust_by_rfm", _robust_by("rfm_segment"))
_register("robust_by_platform_exact", _robust_by("origin_platform", "cont"))


@_query
def ab_by_all_segments(spark, sf_dir):
    return summary.ab_metrics_by_segments(
        scored_users(spark, sf_dir), segments.DEFAULT_SEGMENTS, ids_unique=True
    )


@_query
def heavy_rate_pivot(spark, sf_dir):
    return reshape.heavy_rate_pivot(_robust_by("origin_platform")(spark, sf_dir))


@_query
def bars_median(spark, sf_dir):
    return reshape.prepare_bars_from_robust(_robust_by("heavy_user")(spark, sf_dir))


@_query
def bars_p95(spark, sf_dir):
    return reshape.prepare_bars_from_robust(
        _robust_by("heavy_user")(spark, sf_dir), which="p95"
    )


@_query
def segment_bars_long(spark, sf_dir):
    table = _by_segment("rfm_segment")(spark, sf_dir)
    return reshape.segment_bars_long(table, "rfm_segment")


@_query
def group_bars_long(spark, sf_dir):
    return reshape.group_bars_long(ab_summary(spark, sf_dir))


# ---- segments and samples ----------------------------------------------------


@_query
def rfm_scores(spark, sf_dir):
    scored = segments.build_rfm_buckets(
        users.recency_from_last_event(silver_users(spark, sf_dir))
    )
    return scored.select("customer_id", "r_score", "f_score", "m_score", "rfm_segment")


@_query
def rfm_tiers(spark, sf_dir):
    tiers = segments.rfm_tiers(scored_users(spark, sf_dir))
    return tiers.groupBy("rfm_tier", "is_target").agg(
        F.count("*").alias("usuarios"), F.avg("monetary").alias("gmv_user")
    )


@_query
def hash_sample(spark, sf_dir):
    return sampling.user_level_for_tests(silver_users(spark, sf_dir), sample_frac=0.15)


@_query
def hash_sample_capped(spark, sf_dir):
    sample = sampling.user_level_for_tests(silver_users(spark, sf_dir), sample_frac=0.5)
    return sampling.cap_rows(sample, 100).select("customer_id", "is_target", "monetary")


@_query
def rfm_for_sample(spark, sf_dir):
    sample = sampling.user_level_for_tests(silver_users(spark, sf_dir), sample_frac=0.15)
    return segments.rfm_for_sample(scored_users(spark, sf_dir), sample)


def _clipped(spark: SparkSession, sf_dir: str, p: float) -> DataFrame:
    return sampling.winsorize(with_user_metrics(silver_users(spark, sf_dir)), p=p)


_CLIPPED_COLUMNS = ("customer_id", "is_target", "monetary", "frequency", "aov_user")


@_query
def winsorize_global(spark, sf_dir):
    return _clipped(spark, sf_dir, 0.01).select(*_CLIPPED_COLUMNS)


@_query
def winsorize_2pct(spark, sf_dir):
    return _clipped(spark, sf_dir, 0.02).select(*_CLIPPED_COLUMNS)


@_query
def winsorize_by_group(spark, sf_dir):
    table = sampling.winsorize_by_group(with_user_metrics(silver_users(spark, sf_dir)))
    return table.select(*_CLIPPED_COLUMNS)


@_query
def winsorized_means(spark, sf_dir):
    return summary.group_means(_clipped(spark, sf_dir, 0.01))


# ---- tests -------------------------------------------------------------------
@_query
def welch_ttest(spark, sf_dir):
    table = significance.welch_ttest(
        with_user_metrics(silver_users(spark, sf_dir)),
        metrics=["monetary", "frequency", "aov_user"],
    )
    return table


@_query
def mann_whitney(spark, sf_dir):
    return significance.mann_whitney(silver_users(spark, sf_dir))


@_query
def ztest_conversion(spark, sf_dir):
    return significance.ztest_proportions(
        with_user_metrics(silver_users(spark, sf_dir))
    )


@_query
def ztest_heavy_rate(spark, sf_dir):
    flagged = silver_users(spark, sf_dir).withColumn("heavy", F.col("heavy_user").cast("int"))
    return significance.ztest_proportions(flagged, flag_col="heavy")


@_query
def ab_tests(spark, sf_dir):
    return significance.run_ab_tests(silver_users(spark, sf_dir))


@_query
def nonparam_tests(spark, sf_dir):
    return significance.run_nonparam_tests(silver_users(spark, sf_dir))


# The names under which the p-values were first published.
_register("ab_tests_pvalues", ab_tests)
_register("nonparam_tests_pvalues", nonparam_tests)


def _nonparam_by(column: str) -> Query:
    def run(spark, sf_dir):
        return significance.nonparam_tests_by_segment(
            scored_users(spark, sf_dir), segment_col=column
        )

    return run


_register("nonparam_by_heavy", _nonparam_by("heavy_user"))
_register("nonparam_by_new", _nonparam_by("is_new_customer"))
_register("nonparam_by_platform", _nonparam_by("origin_platform"))
_register("nonparam_by_rfm", _nonparam_by("rfm_segment"))


@_query
def nonparam_by_rfm_auto(spark, sf_dir):
    """RFM cells, the exact test where a cell is small and without ties (ST2, ST6)."""
    return significance.nonparam_tests_by_segment(
        scored_users(spark, sf_dir), segment_col="rfm_segment", method="auto"
    )


# ---- economics ---------------------------------------------------------------


@_query
def financial_viability(spark, sf_dir):
    return finance.financial_viability(silver_users(spark, sf_dir), ids_unique=True)


@_query
def finance_by_heavy(spark, sf_dir):
    return finance.finance_by_segment(
        silver_users(spark, sf_dir), segment_col="heavy_user", ids_unique=True
    )


@_query
def finance_by_platform(spark, sf_dir):
    return finance.finance_by_segment(
        silver_users(spark, sf_dir), segment_col="origin_platform", ids_unique=True
    )


def _break_even(spark: SparkSession, sf_dir: str, column: str | None = None) -> DataFrame:
    return finance.break_even_table(
        silver_users(spark, sf_dir), segment_col=column, ids_unique=True
    )


@_query
def break_even_overall(spark, sf_dir):
    return _break_even(spark, sf_dir)


@_query
def break_even_heavy(spark, sf_dir):
    return _break_even(spark, sf_dir, "heavy_user")


@_query
def break_even_platform(spark, sf_dir):
    return _break_even(spark, sf_dir, "origin_platform")


@_query
def break_even_rounded(spark, sf_dir):
    return finance.round_break_even(_break_even(spark, sf_dir, "origin_platform"))


@_query
def coverage_share(spark, sf_dir):
    return finance.coverage_share(
        silver_users(spark, sf_dir), _break_even(spark, sf_dir, "origin_platform"),
        segment_col="origin_platform", statuses=["NEG"], ids_unique=True,
    )


@_query
def projection_platform(spark, sf_dir):
    return finance.project_profit(
        _break_even(spark, sf_dir, "origin_platform"), mode="campanhas",
        users=silver_users(spark, sf_dir), segment_col="origin_platform", ids_unique=True,
    )


@_query
def projection_continuous(spark, sf_dir):
    table = silver_users(spark, sf_dir)
    days = users.period_days(table).scalar()
    return finance.project_profit(
        _break_even(spark, sf_dir, "origin_platform"), annual_factor=F.lit(365.0) / days,
        adjust_coverage=False,
    )


@_query
def projection_excluding_neg(spark, sf_dir):
    return finance.project_without_losers(
        silver_users(spark, sf_dir),
        _break_even(spark, sf_dir, "origin_platform"),
        _break_even(spark, sf_dir, "heavy_user"),
        ids_unique=True,
    )


@_query
def projection_selected_segments(spark, sf_dir):
    return finance.project_profit(
        _break_even(spark, sf_dir, "origin_platform"), segments=["android", "ios"],
        mode="campanhas", users=silver_users(spark, sf_dir), segment_col="origin_platform",
        ids_unique=True,
    )


# ---- quality -----------------------------------------------------------------


@_query
def dq_time_range(spark, sf_dir):
    return quality.time_range(silver_orders(spark, sf_dir))


@_query
def dq_ab_split(spark, sf_dir):
    return quality.ab_split(silver_users(spark, sf_dir))


@_query
def dq_null_counts(spark, sf_dir):
    enriched = fact.enrich_orders_for_analysis(
        silver_orders(spark, sf_dir), _means(spark, sf_dir)
    )
    return quality.null_counts(enriched)


@_query
def dq_null_counts_all(spark, sf_dir):
    return quality.null_counts(silver_orders(spark, sf_dir), None)


@_query
def dq_semantic_dups(spark, sf_dir):
    return quality.duplicate_groups(silver_orders(spark, sf_dir), ids_unique=True)


_COARSE_KEYS = ("merchant_id", "event_date_brt", "origin_platform")


@_query
def dq_duplicate_groups_coarse(spark, sf_dir):
    groups = quality.duplicate_groups(silver_orders(spark, sf_dir), _COARSE_KEYS)
    return quality.worst_duplicates(groups, 10)


@_query
def dq_duplicate_members(spark, sf_dir):
    return quality.duplicate_members(
        silver_orders(spark, sf_dir), _COARSE_KEYS, ids_unique=True
    ).withColumn("order_ids", F.array_join("order_ids", ","))


@_query
def dq_duplicate_total(spark, sf_dir):
    return quality.duplicate_total(
        quality.duplicate_groups(silver_orders(spark, sf_dir), _COARSE_KEYS, ids_unique=True)
    )


@_query
def dq_profile(spark, sf_dir):
    raw = raw_tables(spark, sf_dir)
    return quality.profile_loaded(raw.orders, raw.consumers, raw.restaurants, raw.abmap)


@_query
def dq_raw_groups(spark, sf_dir):
    return quality.raw_group_counts(raw_tables(spark, sf_dir).abmap)


# ---- charts ------------------------------------------------------------------

_CHART_METRICS = ("monetary", "frequency", "aov_user")


@_query
def boxplot_ab(spark, sf_dir):
    table = with_user_metrics(silver_users(spark, sf_dir))
    return charts.boxplot_stats(table, _CHART_METRICS, clip_p=0.01)


@_query
def boxplot_by_platform(spark, sf_dir):
    return charts.boxplot_stats(
        silver_users(spark, sf_dir), ["monetary"], keys=["origin_platform"]
    )


@_query
def hist_ab(spark, sf_dir):
    table = with_user_metrics(silver_users(spark, sf_dir))
    return charts.density_histogram(table, _CHART_METRICS, clip_p=0.01)


@_query
def hist_by_platform(spark, sf_dir):
    return charts.density_histogram(
        silver_users(spark, sf_dir), ["monetary"], keys=["origin_platform"], bins=40
    )


# ---- report rules ------------------------------------------------------------


@_query
def break_even_grid(spark, sf_dir):
    return extensions.break_even_grid(
        silver_users(spark, sf_dir), segment_col="origin_platform", ids_unique=True
    )


@_query
def break_even_status3(spark, sf_dir):
    return extensions.break_even_status3(_break_even(spark, sf_dir, "origin_platform"))


@_query
def governance_checkpoint(spark, sf_dir):
    return extensions.governance_checkpoint(silver_orders(spark, sf_dir), min_treated=3)


def _cuped(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_tables(spark, sf_dir)
    return _staged(
        spark, sf_dir, "users_cuped",
        lambda: extensions.cuped_users(
            conform.conform_orders(raw.orders, columns=conform.USER_ORDER_COLUMNS),
            conform.conform_abmap(raw.abmap),
            *WINDOW,
        ),
    )


@_query
def cuped_ttest(spark, sf_dir):
    return extensions.cuped_ttest(_cuped(spark, sf_dir))


@_query
def assigned_conversion(spark, sf_dir):
    abmap = conform.conform_abmap(raw_tables(spark, sf_dir).abmap)
    return extensions.assigned_conversion(abmap, silver_users(spark, sf_dir))


@_query
def poststratified_uplift(spark, sf_dir):
    return extensions.poststratified_uplift(silver_users(spark, sf_dir), ids_unique=True)
