"""Maps an order/line star schema (orders, lineitem, customer, part, nation) onto the sources.

The typed form feeds the model directly. The text form renders the same values
as text, as a CSV source would deliver them, and goes through staging.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.config import AnalysisConfig
from cartlens.functions.time import plus_days
from cartlens.plans.staging import COLUMNS, INT, KEY_INT, MONEY, SCORE, TIME

# Window and thresholds used with the star tables.
STAR_CONFIG = AnalysisConfig.from_mapping(
    {
        "analysis_start": "1996-02-01",
        "analysis_end": "1997-07-31",
        "observation_end": "1997-07-31 23:59:59",
        "min_state_orders": 30,
        "min_group_orders": 1,
    }
)

# Days of promised delivery time per priority step ("1-URGENT" ... "5-LOW").
_DAYS_PER_PRIORITY = 300


def read_star(spark: SparkSession, path: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/{table}.parquet")


def _money(amount: str) -> Column:
    return F.col(amount).cast("decimal(18,2)")


def _status(code: Column, shipped: Column, strict: bool) -> Column:
    delivered = F.lit("delivered") if strict else F.when(shipped.isNull(), "unavailable").otherwise("delivered")
    return F.when(code == "F", delivered).when(code == "O", "shipped").when(code == "P", "canceled")


def star_orders(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """All orders, with the last ship date as delivery.

    A delivered order without lines breaks a blocking check, so it becomes "unavailable"; ``strict`` keeps it as it is,
    to show how missing amounts spread. The join uses the text key of the model, so the orders keep this partitioning
    when item, payment and review aggregates are joined to them later.
    """
    orders = read_star(spark, path, "orders").withColumn(
        "order_id", F.col("o_orderkey").cast("string")
    )
    shipped = (
        read_star(spark, path, "lineitem")
        .groupBy(F.col("l_orderkey").cast("string").alias("order_id"))
        .agg(F.max("l_shipdate").alias("_shipped"))
    )
    priority = F.substring("o_orderpriority", 1, 1).cast("int")
    joined = orders.join(shipped, "order_id", "left")
    return joined.select(
        "order_id",
        F.col("o_custkey").cast("string").alias("customer_id"),
        _status(F.col("o_orderstatus"), F.col("_shipped"), strict).alias("order_status"),
        F.col("o_orderdate").alias("order_purchase_timestamp"),
        F.col("o_orderdate").alias("order_approved_at"),
        F.lit(None).cast("timestamp_ntz").alias("order_delivered_carrier_date"),
        F.col("_shipped").alias("order_delivered_customer_date"),
        plus_days(F.col("o_orderdate"), priority * _DAYS_PER_PRIORITY).alias(
            "order_estimated_delivery_date"
        ),
    )


def star_tables(spark: SparkSession, path: str, strict: bool = False) -> dict[str, DataFrame]:
    """The seven typed source tables."""
    lines = read_star(spark, path, "lineitem")
    items = lines.select(
        F.col("l_orderkey").cast("string").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").cast("string").alias("product_id"),
        F.col("l_suppkey").cast("string").alias("seller_id"),
        F.col("l_shipdate").alias("shipping_limit_date"),
        _money("l_extendedprice").alias("price"),
        _money("l_quantity").alias("freight_value"),
    )
    reviews = lines.select(
        F.concat_ws("-", "l_partkey", "l_linenumber").alias("review_id"),
        F.col("l_orderkey").cast("string").alias("order_id"),
        (F.col("l_quantity").cast("int") % 7).alias("review_score"),
        F.lit(None).cast("string").alias("review_comment_title"),
        F.lit(None).cast("string").alias("review_comment_message"),
        plus_days(F.col("l_shipdate"), -F.col("l_linenumber")).alias("review_creation_date"),
        F.when(F.col("l_linestatus") == "F", F.col("l_shipdate")).alias("review_answer_timestamp"),
    )
    payments = read_star(spark, path, "orders").select(
        F.col("o_orderkey").cast("string").alias("order_id"),
        F.lit(1).alias("payment_sequential"),
        F.lower("o_orderpriority").alias("payment_type"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("payment_installments"),
        _money("o_totalprice").alias("payment_value"),
    )
    nations = read_star(spark, path, "nation").select("n_nationkey", "n_name")
    customers = (
        read_star(spark, path, "customer")
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            F.col("c_custkey").cast("string").alias("customer_id"),
            F.col("c_custkey").cast("string").alias("customer_unique_id"),
            F.col("c_nationkey").cast("string").alias("customer_zip_code_prefix"),
            F.lower("c_mktsegment").alias("customer_city"),
            F.coalesce("n_name", F.lit("UNKNOWN")).alias("customer_state"),
        )
    )
    parts = read_star(spark, path, "part")
    products = parts.select(
        F.col("p_partkey").cast("string").alias("product_id"),
        F.col("p_brand").alias("product_category_name"),
        F.length("p_name").alias("product_name_lenght"),
        F.length("p_type").alias("product_description_lenght"),
        F.col("p_size").alias("product_photos_qty"),
        F.col("p_size").cast("double").alias("product_weight_g"),
        F.lit(None).cast("double").alias("product_length_cm"),
        F.lit(None).cast("double").alias("product_height_cm"),
        F.lit(None).cast("double").alias("product_width_cm"),
    )
    number = F.regexp_extract("p_brand", r"([0-9]+)$", 1)
    translation = (
        parts.select("p_brand")
        .distinct()
        .filter(number.try_cast("int") % 2 == 1)
        .select(
            F.col("p_brand").alias("product_category_name"),
            F.concat(F.lit("brand_"), number).alias("product_category_name_english"),
        )
    )
    return {
        "orders": star_orders(spark, path, strict),
        "items": items,
        "payments": payments,
        "customers": customers,
        "products": products,
        "reviews": reviews,
        "category_translation": translation,
    }


def star_text_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The same tables with every column rendered as text."""

    def render(name: str, kind: str) -> Column:
        column = F.col(name)
        if kind in (TIME, MONEY, INT, KEY_INT, SCORE):
            return column.cast("string").alias(name)
        if kind == "double":
            return column.cast("decimal(18,2)").cast("string").alias(name)
        return column.alias(name)

    return {
        table: df.select(*[render(name, kind) for name, kind in COLUMNS[table].items()])
        for table, df in star_tables(spark, path).items()
    }
