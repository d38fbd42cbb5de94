"""What is broken on purpose in the source texts, for the checks on dirty input.

Fixed values: a row whose number (the digits at the end of its key) is divisible by the modulus gets the value in the column;
copies of such rows are added with one column replaced (None: an exact copy).
"""

# source: key column, changes (modulus, column, value), copies (modulus, column, value)
DIRT = {
    "orders": ("order_id", [
        (97, "order_status", "lost"), (101, "order_purchase_timestamp", "at noon"), (103, "order_approved_at", "2020-13-01"),
        (107, "order_delivered_carrier_date", "x"), (109, "order_delivered_customer_date", "soon"),
        (113, "order_estimated_delivery_date", "?"), (127, "customer_id", "nobody"), (131, "order_id", " "),
    ], [(137, None, None), (139, "order_delivered_carrier_date", "2001-01-01 00:00:00")]),
    "items": ("order_id", [
        (97, "price", "-5.00"), (101, "price", "abc"), (103, "price", None), (107, "freight_value", "1.234"), (109, "order_item_id", "0"),
        (113, "order_item_id", "x"), (127, "product_id", "gone"), (131, "order_id", "ghost"), (137, "shipping_limit_date", "tomorrow"),
    ], [(139, None, None)]),
    "payments": ("order_id", [
        (97, "payment_value", "-1"), (101, "payment_sequential", "-3"), (103, "order_id", "ghost"), (107, "payment_sequential", ""),
    ], [(109, None, None), (113, "payment_type", "other")]),
    "customers": ("customer_id", [(11, "customer_unique_id", " "), (13, "customer_id", "")], [(17, "customer_city", "elsewhere"), (19, None, None)]),
    "products": ("product_id", [(7, "product_category_name", " "), (11, "product_id", None)], [(13, None, None), (17, "product_photos_qty", "999")]),
    "reviews": ("order_id", [
        (97, "review_creation_date", "x"), (101, "review_answer_timestamp", "later"), (103, "review_id", ""), (107, "order_id", "ghost"),
        (109, "review_score", "1.5"),
    ], [(113, None, None), (127, "review_score", "5")]),
    "category_translation": ("product_category_name", [(11, "product_category_name", " ")], [(3, None, None), (5, "product_category_name_english", "twice")]),
}
