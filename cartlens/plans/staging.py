"""All-text source tables to typed staging tables, driven by a column specification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlens.functions import casts

TEXT, VERBATIM, STATE = "text", "verbatim", "state"
KEY_INT, INT, SCORE, MONEY, DOUBLE, TIME = "key_int", "int", "score", "money", "double", "time"

_CASTS = {
    TEXT: casts.blank_to_null,
    VERBATIM: lambda column: column,
    STATE: lambda column: casts.unknown_member(casts.blank_to_null(column)),
    KEY_INT: casts.text_to_key_integer,
    INT: casts.text_to_integer,
    SCORE: casts.text_to_score,
    MONEY: casts.text_to_money,
    DOUBLE: casts.text_to_double,
    TIME: casts.text_to_timestamp,
}

# Source columns (with the sources' own spelling) and staged types.
COLUMNS = {
    "orders": {
        "order_id": TEXT,
        "customer_id": TEXT,
        "order_status": TEXT,
        "order_purchase_timestamp": TIME,
        "order_approved_at": TIME,
        "order_delivered_carrier_date": TIME,
        "order_delivered_customer_date": TIME,
        "order_estimated_delivery_date": TIME,
    },
    "items": {
        "order_id": TEXT,
        "order_item_id": KEY_INT,
        "product_id": TEXT,
        "seller_id": TEXT,
        "shipping_limit_date": TIME,
        "price": MONEY,
        "freight_value": MONEY,
    },
    "payments": {
        "order_id": TEXT,
        "payment_sequential": KEY_INT,
        "payment_type": TEXT,
        "payment_installments": INT,
        "payment_value": MONEY,
    },
    "customers": {
        "customer_id": TEXT,
        "customer_unique_id": TEXT,
        "customer_zip_code_prefix": TEXT,
        "customer_city": TEXT,
        "customer_state": STATE,
    },
    "products": {
        "product_id": TEXT,
        "product_category_name": TEXT,
        "product_name_lenght": INT,
        "product_description_lenght": INT,
        "product_photos_qty": INT,
        "product_weight_g": DOUBLE,
        "product_length_cm": DOUBLE,
        "product_height_cm": DOUBLE,
        "product_width_cm": DOUBLE,
    },
    "reviews": {
        "review_id": TEXT,
        "order_id": TEXT,
        "review_score": SCORE,
        "review_comment_title": VERBATIM,
        "review_comment_message": VERBATIM,
        "review_creation_date": TIME,
        "review_answer_timestamp": TIME,
    },
    "category_translation": {
        "product_category_name": TEXT,
        "product_category_name_english": TEXT,
    },
}

# Business keys.
KEYS = {
    "orders": ["order_id"],
    "items": ["order_id", "order_item_id"],
    "payments": ["order_id", "payment_sequential"],
    "customers": ["customer_id"],
    "products": ["product_id"],
    "reviews": ["review_id", "order_id"],
    "category_translation": ["product_category_name"],
}


def raw_name(column: str) -> str:
    return column + "_raw"


def stage_table(raw: DataFrame, table: str) -> DataFrame:
    """Drop exact copies of the declared columns, then type them beside the original text."""
    spec = COLUMNS[table]
    unique = raw.select(*spec).dropDuplicates()
    typed = [_CASTS[kind](F.col(name)).alias(name) for name, kind in spec.items()]
    original = [F.col(name).alias(raw_name(name)) for name in spec]
    return unique.select(*typed, *original)


def stage_all(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {table: stage_table(raw[table], table) for table in COLUMNS}
