"""Raw experiment inputs derived from the order tables at hand.

The tables hold no experiment, so assignment, dates in text form, platforms and
dirt are derived from keys. Every expression is valid in Spark SQL and in other
SQL dialects alike; only the name of the text type differs (``{S}``), so a check
in another engine can start from the very same inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .silver import Raw

WINDOW = ("1997-01-01", "1998-07-01")

_TREATED = "({key} * 7919) % 100 < 55"

LINE_SUMMARY = (
    "select l_orderkey, min(l_suppkey) as m, cast(count(*) as int) as n "
    "from {lineitem} group by l_orderkey"
)

# Day texts and hour of an order, from its date and key.
ORDER_HELPERS = {
    "d": "cast(cast(o_orderdate as date) as {S})",
    "d1": "cast(cast(o_orderdate as date) + 1 as {S})",
    "d0": "cast(cast(o_orderdate as date) - 1 as {S})",
    "h": "lpad(cast(o_orderkey % 24 as {S}), 2, '0')",
}

ORDERS = {
    "order_id": "cast(o_orderkey as {S})",
    "customer_id": "case when o_orderkey % 211 = 0 then null else cast(o_custkey as {S}) end",
    "merchant_id": "cast(m as {S})",
    "order_total_amount": (
        "case when o_orderkey % 97 = 0 then null "
        "when o_orderkey % 101 = 0 then -o_totalprice "
        f"when {_TREATED.format(key='o_custkey')} "
        "then o_totalprice / cast(5000 as double) * cast(1.1 as double) "
        "else o_totalprice / cast(5000 as double) end"
    ),
    "order_created_at": (
        "case when o_orderkey % 89 = 0 then 'not-a-date' "
        "when o_orderkey % 4 = 0 then d || ' ' || h || ':30:00' "
        "when o_orderkey % 4 = 1 then d || 'T' || h || ':30:00.125Z' "
        "when o_orderkey % 4 = 2 then d "
        "else d || 'T' || h || ':30:00Z' end"
    ),
    "order_scheduled": (
        "case when o_orderkey % 5 = 0 then true when o_orderkey % 7 = 0 then null else false end"
    ),
    "order_scheduled_date": (
        "case when o_orderkey % 35 = 0 then d0 || ' 12:00:00' "
        "when o_orderkey % 5 = 0 then d1 || ' 12:00:00' else null end"
    ),
    "origin_platform": (
        "case o_orderpriority when '1-URGENT' then 'ANDROID' when '2-HIGH' then 'IOS' "
        "when '3-MEDIUM' then 'Desktop' when '4-NOT SPECIFIED' then 'android' else null end"
    ),
    "merchant_timezone": (
        "case o_orderkey % 3 when 0 then 'America/Sao_Paulo' when 1 then 'America/Manaus' "
        "else null end"
    ),
    "merchant_latitude": "cast(o_orderkey % 200 as double) - 100",
    "merchant_longitude": "cast(o_orderkey % 400 as double) - 200",
    "items": (
        "case when n is null then null when o_orderkey % 13 = 0 then 'oops' "
        "when o_orderkey % 17 = 0 then '[bad' "
        """else '[{{"a":"1"}}' || repeat(',{{"a":"1"}}', n - 1) || ']' end"""
    ),
    "cpf": "lpad(cast(o_custkey as {S}), 11, '0')",
    "customer_name": "'Customer ' || cast(o_custkey as {S})",
}

# Later copies of some orders, with another amount.
ORDER_COPIES = {
    **ORDERS,
    "order_total_amount": f"({ORDERS['order_total_amount']}) + cast(1 as double)",
    "order_created_at": "d1 || ' 23:59:00'",
}
COPIED = "o_orderkey % 100 = 7"

# The same orders once more under other ids.
ORDER_TWINS = {**ORDERS, "order_id": "cast(o_orderkey as {S}) || '-again'"}
TWINNED = "o_orderkey % 300 = 4"

CONSUMERS = {
    "customer_id": "cast(c_custkey as {S})",
    "language": "case c_nationkey % 3 when 0 then 'pt-BR' when 1 then 'EN-us' else null end",
    "created_at": (
        "case when c_custkey % 41 = 0 then null else "
        "cast(date '1996-01-01' + cast((c_custkey * 37) % 1500 as int) as {S}) || ' 00:00:00' end"
    ),
    "active": (
        "case when c_custkey % 10 = 0 then null when c_acctbal > 0 then 'true' else 'false' end"
    ),
    "customer_name": "c_name",
    "customer_phone_area": (
        "case when c_custkey % 19 = 0 then null else cast(10 + c_nationkey as {S}) end"
    ),
    "customer_phone_number": (
        "case when c_custkey % 38 = 0 then null else cast(900000000 + c_custkey as {S}) end"
    ),
}

RESTAURANTS = {
    "id": "cast(s_suppkey as {S})",
    "created_at": (
        "cast(date '1994-01-01' + cast(s_suppkey % 900 as int) as {S}) || ' 08:00:00'"
    ),
    "enabled": "case when s_suppkey % 8 = 0 then 'false' else 'true' end",
    "price_range": (
        "case when s_suppkey % 9 = 0 then null else cast(s_suppkey % 5 + 1 as {S}) end"
    ),
    "average_ticket": "s_acctbal / cast(100 as double)",
    "delivery_time": (
        "case when s_suppkey % 4 = 0 then null else cast(s_suppkey % 60 + 10 as double) end"
    ),
    "minimum_order_value": (
        "case when s_suppkey % 3 = 0 then null else cast(s_suppkey % 7 as double) * 5 - 5 end"
    ),
    "merchant_zip_code": "lpad(cast(s_suppkey as {S}), 5, '0')",
    "merchant_city": "'City ' || cast(s_nationkey as {S})",
    "merchant_state": "'S' || cast(s_nationkey % 5 as {S})",
    "merchant_country": "'BR'",
}

ABMAP = {
    "customer_id": "cast(c_custkey as {S})",
    "ab_group": (
        "case when c_custkey % 83 = 0 then 'x' "
        f"when {_TREATED.format(key='c_custkey')} then case c_custkey % 4 "
        "when 0 then 'treatment' when 1 then 'B' when 2 then '1' else 'Teste' end "
        "else case c_custkey % 4 "
        "when 0 then 'control' when 1 then 'a' when 2 then '0' else 'Controle' end end"
    ),
}
ASSIGNED = "c_custkey % 50 <> 0"


def select_list(columns: dict[str, str], text_type: str = "string") -> str:
    return ",\n  ".join(f"{e.format(S=text_type)} as {n}" for n, e in columns.items())


def raw_tables(spark: SparkSession, sf_dir: str) -> Raw:
    """The four raw inputs as lazy DataFrames."""

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")

    lines = spark.sql(LINE_SUMMARY, lineitem=table("lineitem"))
    orders = table("orders")
    base = orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"], "left").selectExpr(
        "*", *[f"{e.format(S='string')} as {n}" for n, e in ORDER_HELPERS.items()]
    )

    def structs(columns: dict[str, str]) -> str:
        return f"struct({select_list(columns)})"

    # Copies leave the same row, so lines and orders are read and joined once.
    versions = (
        f"array_compact(array({structs(ORDERS)}, "
        f"case when {COPIED} then {structs(ORDER_COPIES)} end, "
        f"case when {TWINNED} then {structs(ORDER_TWINS)} end))"
    )

    def pick(df: DataFrame, columns: dict[str, str]) -> DataFrame:
        return df.selectExpr(*[f"{e.format(S='string')} as {n}" for n, e in columns.items()])

    return Raw(
        orders=base.selectExpr(f"inline({versions})"),
        consumers=pick(table("customer"), CONSUMERS),
        restaurants=pick(table("supplier"), RESTAURANTS),
        abmap=pick(table("customer").where(ASSIGNED), ABMAP),
    )
