"""Names, labels and formats that decide the results.

They describe the input files and the published result tables, so they are
listed here as they are and nowhere else.
"""

BUSINESS_TZ = "America/Sao_Paulo"

# Timestamp formats accepted in raw text, besides Spark's own parser.
TIMESTAMP_FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss.SSSX",
    "yyyy-MM-dd'T'HH:mm:ssX",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd",
)

# Personal data that never leaves the conform step.
ORDER_PII = (
    "cpf",
    "customer_name",
    "delivery_address_external_id",
    "delivery_address_city",
    "delivery_address_country",
    "delivery_address_district",
    "delivery_address_latitude",
    "delivery_address_longitude",
    "delivery_address_state",
    "delivery_address_zip_code",
)

# Where the experiment arm may be found in an assignment file, best first.
GROUP_COLUMN_CANDIDATES = (
    "is_target",
    "target",
    "treatment",
    "group",
    "ab_group",
    "variant",
    "bucket",
)

TREATMENT_LABELS = ("treatment", "test", "teste", "target", "variant_b", "b", "1", "true")
CONTROL_LABELS = ("control", "controle", "variant_a", "a", "0", "false")

ORDERS_SILVER_COLUMNS = (
    "order_id",
    "customer_id",
    "merchant_id",
    "event_ts_utc",
    "event_date_brt",
    "order_created_at",
    "order_scheduled",
    "order_total_amount",
    "origin_platform",
    "basket_size",
    "is_target",
    "language",
    "active",
    "consumer_created_at",
    "enabled",
    "price_range",
    "average_ticket",
    "delivery_time",
    "minimum_order_value",
    "merchant_city",
    "merchant_state",
    "merchant_country",
    "merchant_created_at",
)

NULL_CHECK_COLUMNS = (
    "order_id",
    "customer_id",
    "merchant_id",
    "event_ts_utc",
    "order_total_amount",
    "is_target",
    "price_range",
    "language",
    "active",
    "delivery_time_imputed",
    "minimum_order_value_imputed",
)

REQUIRED_FILES = {
    "orders": "order.json.gz",
    "consumers": "consumer.csv.gz",
    "restaurants": "restaurant.csv.gz",
    "ab_tar": "ab_test_ref.tar.gz",
}
SHARDED_ORDERS_DIR = "orders_sharded"
EXTRACTED_AB_DIR = "ab_test_ref_extracted"

# Economics and analysis settings used when the caller gives none.
TAKE_RATE = 0.23
COUPON_COST = 10.0
REDEMPTION_RATE = 0.30
COUPON_COST_GRID = (3.0, 6.0, 9.0, 12.0, 15.0)
HEAVY_THRESHOLD = 3
RFM_QUANTILES = (0.2, 0.4, 0.6, 0.8)
GROUP_NAMES = {0: "Controle", 1: "Tratamento"}

# Order fields read from raw JSON.
RAW_ORDER_FIELDS = (
    "order_id",
    "customer_id",
    "merchant_id",
    "order_created_at",
    "order_scheduled_date",
    "order_total_amount",
    "order_scheduled",
    "origin_platform",
    "merchant_latitude",
    "merchant_longitude",
    "merchant_timezone",
    "items",
    "cpf",
    "customer_name",
)
MIN_LINES_PER_SHARD = 200_000
LINES_PER_TARGET_MB = 10_000

# Names under which the orders may also lie in the raw folder.
ORDER_CANDIDATES = ("order.json", "order.json.gz", "orders.json", "orders.json.gz")

# Columns by which two orders count as the same.
DUPLICATE_KEYS = ("customer_id", "merchant_id", "event_ts_utc", "order_total_amount")

# Columns of the user table and of the break-even table, in their published order.
USER_COLUMNS = (
    "customer_id",
    "last_order",
    "frequency",
    "monetary",
    "is_target",
    "consumer_created_at",
    "origin_platform",
    "active",
    "recency",
    "is_new_customer",
    "heavy_user",
)
BREAK_EVEN_COLUMNS = (
    "segment",
    "usuarios_trat",
    "gmv_ctrl",
    "gmv_trat",
    "uplift_gmv_user",
    "uplift_needed",
    "gap_uplift",
    "receita_total",
    "custo_total",
    "lucro_total",
    "lucro_por_usuario",
    "roi_percent",
    "status",
)
# Decimals shown in the published break-even table.
ROUNDING = {
    "gmv_ctrl": 2,
    "gmv_trat": 2,
    "uplift_gmv_user": 2,
    "uplift_needed": 2,
    "gap_uplift": 2,
    "lucro_por_usuario": 2,
    "receita_total": 0,
    "custo_total": 0,
    "lucro_total": 0,
    "roi_percent": 3,
}
# Columns of a user sample.
SAMPLE_COLUMNS = ("customer_id", "is_target", "frequency", "monetary")
SAMPLE_EXTRA_COLUMNS = ("heavy_user", "is_new_customer", "origin_platform")
