"""Raw tables to typed, deduplicated, PII-free tables.

Every function is lazy and touches no data at plan time; absent columns become
typed NULLs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (
    column_or_null,
    keep_first,
    not_negative,
    require_columns,
    within,
)
from ..functions.fixed_values import (
    BUSINESS_TZ,
    CONTROL_LABELS,
    GROUP_COLUMN_CANDIDATES,
    ORDER_PII,
    TREATMENT_LABELS,
)
from ..functions.timestamps import (
    business_date,
    event_time,
    has_offset,
    parse_plain,
    parse_timestamp,
)

# Two copies of an order are told apart by these columns in turn. A caller that
# needs only a few order columns gets the same winner, as long as they are a
# prefix of this list.
_TIE_BREAK = (
    "order_created_at",
    "customer_id",
    "event_ts_utc",
    "order_total_amount",
    "origin_platform",
    "merchant_id",
    "order_scheduled",
    "basket_size",
    "event_date_brt",
)
USER_ORDER_COLUMNS = (
    "order_id",
    "order_created_at",
    "customer_id",
    "event_ts_utc",
    "order_total_amount",
    "origin_platform",
)
FACT_ORDER_COLUMNS = USER_ORDER_COLUMNS + (
    "merchant_id",
    "order_scheduled",
    "basket_size",
    "event_date_brt",
)


def basket_size(df: DataFrame, name: str = "items") -> Column:
    """Number of items, from an array or from JSON text holding one (PRJ7-9)."""
    if name not in df.columns:
        return F.lit(None).cast("int")
    if isinstance(df.schema[name].dataType, T.ArrayType):
        return F.size(F.col(name))
    text = F.col(name).cast("string")
    parsed = F.from_json(text, "array<map<string,string>>")
    return F.when(text.rlike(r"^\s*\["), F.size(parsed))


def parse_order_times(
    orders: DataFrame, business_tz: str = BUSINESS_TZ, offset_aware: bool = False
) -> DataFrame:
    """Typed order times and the event time derived from them (PRJ1, PRJ3-6).

    A text with its own UTC offset is an instant already. By default it is moved
    by the zone like the others, which is what the published figures rest on;
    ``offset_aware`` leaves such values alone.
    """
    # Parsed in a step of its own, so that each text is parsed once.
    parsed = {
        "_zone": F.coalesce(
            column_or_null(orders, "merchant_timezone", "string"), F.lit(business_tz)
        ),
        "order_scheduled": column_or_null(orders, "order_scheduled", "boolean"),
    }
    utc = {}
    for name, moved in (("order_created_at", "created_utc"), ("order_scheduled_date", "scheduled_utc")):
        text = column_or_null(orders, name, "string")
        parsed[name] = parse_timestamp(text)
        utc[moved] = F.to_utc_timestamp(F.col(name), F.col("_zone"))
        if offset_aware:
            parsed[f"_{name}_has_offset"] = has_offset(text)
            utc[moved] = F.when(F.col(f"_{name}_has_offset"), F.col(name)).otherwise(utc[moved])
    timed = orders.withColumns(parsed).withColumns(utc)
    timed = timed.drop(*[c for c in parsed if c.startswith("_")])
    timed = timed.withColumn(
        "event_ts_utc",
        event_time(F.col("order_scheduled"), F.col("scheduled_utc"), F.col("created_utc")),
    )
    return timed.withColumn("event_date_brt", business_date(F.col("event_ts_utc"), business_tz))


def hash_order_pii(orders: DataFrame) -> DataFrame:
    """Replace the tax id by its hash and drop the personal columns (PRJ11-12)."""
    if "cpf" in orders.columns:
        orders = orders.withColumn("cpf_hash", F.sha2(F.col("cpf").cast("string"), 256))
    return orders.drop(*ORDER_PII)


def typed_order_rows(
    orders: DataFrame,
    business_tz: str = BUSINESS_TZ,
    *,
    offset_aware: bool = False,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Orders with typed columns, copies and negative amounts still there."""
    require_columns(orders, ["order_id", "customer_id"], "orders")
    typed = {
        "order_id": F.col("order_id").cast("string"),
        "customer_id": F.col("customer_id").cast("string"),
        "order_total_amount": column_or_null(orders, "order_total_amount", "double"),
        "origin_platform": column_or_null(orders, "origin_platform", "string", lower=True),
        "merchant_latitude": within(
            column_or_null(orders, "merchant_latitude", "double"), -90, 90
        ),
        "merchant_longitude": within(
            column_or_null(orders, "merchant_longitude", "double"), -180, 180
        ),
        "basket_size": basket_size(orders),
    }
    if "merchant_id" in orders.columns:
        typed["merchant_id"] = F.col("merchant_id").cast("string")
    known = orders.where(F.col("order_id").isNotNull() & F.col("customer_id").isNotNull())
    wide = hash_order_pii(parse_order_times(known, business_tz, offset_aware).withColumns(typed))
    if columns is not None:
        wide = wide.select(*[c for c in columns if c in wide.columns])
    return wide


def first_copies(rows: DataFrame) -> DataFrame:
    """One row per ``order_id`` of typed rows: the earliest."""
    rank = [c for c in _TIE_BREAK if c in rows.columns]
    rank += sorted(c for c in rows.columns if c not in rank and c != "order_id")
    return keep_first(rows, ["order_id"], rank)


def valid_amount() -> Column:
    amount = F.col("order_total_amount")
    return amount.isNull() | (amount >= 0)


def conform_orders(
    orders: DataFrame,
    business_tz: str = BUSINESS_TZ,
    *,
    offset_aware: bool = False,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Orders with typed columns, one row per ``order_id``.

    ``columns`` narrows the result before the shuffle of the deduplication;
    ``FACT_ORDER_COLUMNS`` and ``USER_ORDER_COLUMNS`` keep the same winners as
    the full width.
    """
    typed = typed_order_rows(orders, business_tz, offset_aware=offset_aware, columns=columns)
    return first_copies(typed).where(valid_amount())


def conform_consumers(consumers: DataFrame) -> DataFrame:
    """Customers: typed, phone hashed, one row per ``customer_id`` (PRJ13)."""
    require_columns(consumers, ["customer_id"], "consumers")
    # The joined text of two missing parts is '', so its hash is a constant.
    phone = F.concat_ws(
        "-",
        column_or_null(consumers, "customer_phone_area", "string"),
        column_or_null(consumers, "customer_phone_number", "string"),
    )
    slim = consumers.where(F.col("customer_id").isNotNull()).select(
        F.col("customer_id").cast("string").alias("customer_id"),
        column_or_null(consumers, "language", "string", lower=True).alias("language"),
        column_or_null(consumers, "active", "boolean").alias("active"),
        F.sha2(phone, 256).alias("phone_hash"),
        parse_plain(column_or_null(consumers, "created_at", "string")).alias(
            "consumer_created_at"
        ),
    )
    return keep_first(
        slim, ["customer_id"], ["consumer_created_at", "active", "language", "phone_hash"]
    )


def conform_restaurants(restaurants: DataFrame) -> DataFrame:
    """Merchants: typed, negative figures blanked, one row per ``merchant_id`` (PRJ14)."""
    require_columns(restaurants, ["id"], "restaurants")

    def typed(name: str, dtype: str) -> Column:
        return column_or_null(restaurants, name, dtype).alias(name)

    numbers = ("average_ticket", "delivery_time", "minimum_order_value")
    places = ("merchant_zip_code", "merchant_city", "merchant_state", "merchant_country")
    slim = restaurants.where(F.col("id").isNotNull()).select(
        F.col("id").cast("string").alias("merchant_id"),
        typed("enabled", "boolean"),
        typed("price_range", "int"),
        *[typed(n, "double") for n in numbers],
        *[typed(p, "string") for p in places],
        parse_plain(column_or_null(restaurants, "created_at", "string")).alias(
            "merchant_created_at"
        ),
    )
    slim = slim.withColumns({n: not_negative(n) for n in numbers})
    rest = ["merchant_created_at"] + [
        c for c in slim.columns if c not in ("merchant_id", "merchant_created_at")
    ]
    return keep_first(slim, ["merchant_id"], rest)


def normalize_headers(df: DataFrame) -> DataFrame:
    """Trimmed lower-case headers with ``_`` for blanks (PRJ15)."""
    return df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])


def group_column(df: DataFrame) -> str:
    """The column that holds the experiment arm (PRJ16)."""
    for name in GROUP_COLUMN_CANDIDATES:
        if name in df.columns:
            return name
    raise ValueError(f"no experiment-arm column among {sorted(df.columns)}")


def arm_from_label(col: Column) -> Column:
    """1 for a treatment label, 0 for a control label, else the integer itself (PRJ17)."""
    text = col.cast("string")
    label = F.lower(text)
    return (
        F.when(label.isin(*TREATMENT_LABELS), F.lit(1))
        .when(label.isin(*CONTROL_LABELS), F.lit(0))
        .otherwise(text.try_cast("int"))
    )


def conform_abmap(abmap: DataFrame) -> DataFrame:
    """Assignment as ``(customer_id, is_target)``, one row per customer (PRJ15-18).

    A customer listed twice gets the smaller arm. The minimum combines on the
    map side, so copies of one customer never travel together.
    """
    named = normalize_headers(abmap)
    require_columns(named, ["customer_id"], "assignment map")
    return (
        named.select(
            F.col("customer_id").cast("string").alias("customer_id"),
            arm_from_label(F.col(group_column(named))).alias("is_target"),
        )
        .groupBy("customer_id")
        .agg(F.min("is_target").alias("is_target"))
    )
