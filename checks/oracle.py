"""SQL for the registered queries, to be run by DuckDB on the raw tables.

Sums of money are taken over decimals and returned as doubles. The role views
are those of ``FIXTURES.md``. Key, relation and rule lists are fixed values: they
must equal the library's.
"""

from __future__ import annotations

VIEWS = {
    "v_customers": """
        SELECT c_custkey AS customer_id, c_custkey - c_custkey % 2 AS customer_unique_id,
               lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS customer_zip_code_prefix,
               c_mktsegment AS customer_city,
               CASE WHEN c_nationkey = 0 THEN NULL ELSE n_name END AS customer_state
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "v_sellers": """
        SELECT s_suppkey AS seller_id, lpad(CAST(s_nationkey AS VARCHAR), 5, '0') AS seller_zip_code_prefix,
               s_name AS seller_city, n_name AS seller_state
        FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""",
    "v_products": """
        SELECT p_partkey AS product_id,
               CASE WHEN p_type = 'PROMO' THEN NULL ELSE lower(p_type) END AS product_category_name,
               CAST(length(p_name) AS BIGINT) AS product_name_lenght,
               CAST(length(p_brand) AS BIGINT) AS product_description_lenght,
               CAST(p_size % 7 AS BIGINT) AS product_photos_qty, CAST(p_size * 10 AS BIGINT) AS product_weight_g,
               CAST(p_size AS BIGINT) AS product_length_cm, CAST(p_size + 1 AS BIGINT) AS product_height_cm,
               CAST(p_size + 2 AS BIGINT) AS product_width_cm
        FROM part""",
    "v_translations": """
        SELECT * FROM (VALUES ('economy','budget'), ('large','big'), ('large','very_big'), ('medium','mid'),
                              ('small','small')) AS t(product_category_name, product_category_name_english)""",
    "v_orders": """
        SELECT o_orderkey AS order_id, CASE WHEN o_custkey % 10 = 0 THEN -o_custkey ELSE o_custkey END AS customer_id,
               CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped' ELSE 'canceled' END AS order_status,
               o_orderdate + INTERVAL 23 HOUR AS order_purchase_timestamp,
               CASE WHEN o_orderkey % 100 = 0 THEN NULL ELSE o_orderdate + INTERVAL 24 HOUR END AS order_approved_at,
               min_ship AS order_delivered_carrier_date,
               CASE WHEN o_orderstatus = 'F' THEN max_ship END AS order_delivered_customer_date,
               o_orderdate + INTERVAL 30 DAY AS order_estimated_delivery_date
        FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS min_ship, max(l_shipdate) AS max_ship
                               FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey""",
    "v_items": """
        SELECT CASE WHEN l_orderkey % 13 = 0 THEN -l_orderkey ELSE l_orderkey END AS order_id, CAST(l_linenumber AS BIGINT) AS order_item_id,
               CASE WHEN l_partkey % 50 = 0 THEN -l_partkey ELSE l_partkey END AS product_id,
               CASE WHEN l_suppkey % 25 = 0 THEN l_suppkey - 1 ELSE l_suppkey END AS seller_id, l_shipdate AS shipping_limit_date, l_extendedprice AS price,
               CASE WHEN l_tax = 0 THEN NULL
                    ELSE CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2)) AS DOUBLE)
               END AS freight_value
        FROM lineitem""",
    "v_payments": """
        SELECT CASE WHEN o_orderkey % 7 = 0 THEN -o_orderkey ELSE o_orderkey END AS order_id, CAST(1 AS BIGINT) AS payment_sequential, lower(o_orderpriority) AS payment_type,
               1 + o_orderkey % 10 AS payment_installments, o_totalprice AS payment_value
        FROM orders
        UNION ALL
        SELECT o_orderkey, 2, 'voucher', CAST(1 AS BIGINT), CAST(10.5 AS DOUBLE)
        FROM orders WHERE o_orderkey % 5 = 0""",
    "v_reviews": """
        SELECT event_id AS review_id, user_id AS order_id, 1 + event_id % 5 AS review_score,
               CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS review_comment_title,
               ts AS review_creation_date, ts + INTERVAL 1 DAY AS review_answer_timestamp
        FROM events""",
    # Lines with exact amounts: price, freight and their sum.
    "line": """
        SELECT *, CAST(coalesce(price, 0) AS DECIMAL(18,4)) AS p, CAST(coalesce(freight_value, 0) AS DECIMAL(18,4)) AS f
        FROM v_items""",
    "order_money": "SELECT order_id, sum(p + f) AS revenue, sum(f) AS freight FROM line GROUP BY order_id",
    # One English name per category.
    "named": """
        SELECT product_id, product_category_name,
               (SELECT min(t.product_category_name_english) FROM v_translations t
                WHERE t.product_category_name = v_products.product_category_name) AS product_category_name_english
        FROM v_products""",
    "categorized": """
        SELECT product_id, product_category_name_english AS category_english,
               coalesce(product_category_name_english, product_category_name, 'uncategorized') AS category
        FROM named""",
}

NEEDS = {
    "line": ["v_items"],
    "order_money": ["line"],
    "named": ["v_products", "v_translations"],
    "categorized": ["named"],
}


def _with(body: str, *views: str) -> str:
    ordered: list[str] = []

    def add(view: str) -> None:
        for needed in NEEDS.get(view, []):
            add(needed)
        if view not in ordered:
            ordered.append(view)

    for view in views:
        add(view)
    return "WITH " + ",\n".join(f"{v} AS ({VIEWS[v]})" for v in ordered) + body


DAYS = "date_diff('day', order_purchase_timestamp, order_delivered_customer_date)"

MONTHLY = f"""
    SELECT CAST(date_trunc('month', order_purchase_timestamp) AS TIMESTAMP) AS month,
           count(DISTINCT order_id) AS orders,
           count(DISTINCT order_id) FILTER (WHERE order_status = 'delivered') AS delivered_orders,
           count(DISTINCT order_id) FILTER (WHERE order_status = 'canceled') AS cancelled_orders,
           CAST(coalesce(sum(revenue), 0) AS DOUBLE) AS revenue,
           CAST(coalesce(sum(freight), 0) AS DOUBLE) AS freight,
           CAST(coalesce(sum(revenue), 0) AS DOUBLE) / count(DISTINCT order_id) AS avg_order_value,
           avg({DAYS}) AS avg_delivery_days,
           any_value(avg_review_score) AS avg_review_score
    FROM v_orders o
    LEFT JOIN order_money USING (order_id)
    LEFT JOIN (
      SELECT month_, list_reduce(list(s / n ORDER BY n), lambda a, b: a + b) / sum(c) AS avg_review_score
      FROM (
        SELECT date_trunc('month', order_purchase_timestamp) AS month_, n, CAST(sum(s) AS BIGINT) AS s, count(*) AS c
        FROM v_orders
        JOIN (SELECT order_id, sum(review_score) AS s, count(review_score) AS n FROM v_reviews GROUP BY order_id) USING (order_id)
        WHERE n > 0 GROUP BY 1, 2
      ) GROUP BY month_
    ) means ON means.month_ IS NOT DISTINCT FROM date_trunc('month', o.order_purchase_timestamp)
    GROUP BY 1"""

PRODUCT = """
    SELECT n.product_id, any_value(product_category_name) AS product_category_name,
           any_value(product_category_name_english) AS product_category_name_english,
           count(DISTINCT order_id) AS total_orders,
           count(l.product_id) AS units_sold,
           CAST(coalesce(sum(p + f), 0) AS DOUBLE) AS revenue,
           CAST(coalesce(sum(f), 0) AS DOUBLE) AS freight_revenue,
           CAST(sum(p) AS DOUBLE) / count(l.product_id) AS avg_price,
           count(DISTINCT seller_id) AS unique_sellers
    FROM named n LEFT JOIN line l ON l.product_id = n.product_id
    GROUP BY n.product_id"""

CATEGORY = """
    SELECT category, category_english,
           count(DISTINCT order_id) AS orders,
           count(l.product_id) AS units_sold,
           CAST(coalesce(sum(p + f), 0) AS DOUBLE) AS revenue,
           CAST(coalesce(sum(f), 0) AS DOUBLE) AS freight_revenue,
           CAST(sum(p) AS DOUBLE) / count(l.product_id) AS avg_price
    FROM categorized c LEFT JOIN line l ON l.product_id = c.product_id
    GROUP BY category, category_english"""

SELLER = f"""
    SELECT s.seller_id,
           count(order_id) AS orders,
           CAST(coalesce(sum(revenue), 0) AS DOUBLE) AS revenue,
           CAST(coalesce(sum(freight), 0) AS DOUBLE) AS freight_revenue,
           CAST(sum(revenue) AS DOUBLE) / nullif(count(order_id), 0) AS avg_order_value,
           avg({DAYS}) AS avg_delivery_days,
           count(*) FILTER (WHERE order_status = 'delivered') AS delivered_orders
    FROM v_sellers s
    LEFT JOIN (SELECT seller_id, order_id, sum(p + f) AS revenue, sum(f) AS freight FROM line GROUP BY ALL) b
           ON b.seller_id = s.seller_id
    LEFT JOIN v_orders USING (order_id)
    GROUP BY s.seller_id"""

CUSTOMER = """
    SELECT c.*, count(order_id) AS orders,
           CAST(coalesce(sum(revenue), 0) AS DOUBLE) AS total_spent,
           CASE WHEN count(order_id) > 0
                THEN CAST(coalesce(sum(revenue), 0) AS DOUBLE) / count(order_id) END AS avg_order_value,
           min(order_purchase_timestamp) AS first_order,
           max(order_purchase_timestamp) AS last_order
    FROM v_customers c
    LEFT JOIN v_orders USING (customer_id)
    LEFT JOIN order_money USING (order_id)
    GROUP BY ALL"""

GEOGRAPHY = f"""
    SELECT customer_state AS state,
           count(DISTINCT customer_unique_id) FILTER (WHERE order_id IS NOT NULL) AS unique_customers,
           count(order_id) AS orders,
           CAST(coalesce(sum(revenue), 0) AS DOUBLE) AS revenue,
           avg({DAYS}) AS avg_delivery_days
    FROM v_customers
    LEFT JOIN v_orders USING (customer_id)
    LEFT JOIN order_money USING (order_id)
    GROUP BY customer_state"""

# Half-even rounding of the exact total in ten-thousandths, then in cents.
PAYMENTS = """
    SELECT payment_type, payment_count,
           CAST((units // 100) + CASE WHEN units % 100 > 50 OR (units % 100 = 50 AND (units // 100) % 2 = 1)
                                      THEN 1 ELSE 0 END AS DOUBLE) / 100 AS total_amount,
           round_even(CAST(amount AS DOUBLE) / amounts, 2) AS average_amount
    FROM (SELECT payment_type, count(*) AS payment_count, count(payment_value) AS amounts,
                 sum(CAST(payment_value AS DECIMAL(18,4))) AS amount,
                 CAST(sum(CAST(payment_value AS DECIMAL(18,4))) * 10000 AS HUGEINT) AS units
          FROM v_payments WHERE order_id IN (SELECT order_id FROM v_orders)
          GROUP BY payment_type)"""

MART_SQL = {
    "monthly_metrics": (MONTHLY, "v_orders", "order_money", "v_reviews"),
    "product_analytics": (PRODUCT, "named", "line"),
    "category_analytics": (CATEGORY, "categorized", "line"),
    "seller_analytics": (SELLER, "v_sellers", "line", "v_orders"),
    "customer_analytics": (CUSTOMER, "v_customers", "v_orders", "order_money"),
    "geography_analytics": (GEOGRAPHY, "v_customers", "v_orders", "order_money"),
}

MART_KEYS = {
    "monthly_metrics": "month",
    "product_analytics": "product_id",
    "category_analytics": "category",
    "seller_analytics": "seller_id",
    "customer_analytics": "customer_id",
    "geography_analytics": "state",
}


def _first_rows(name: str, limit: int) -> str:
    body, *views = MART_SQL[name]
    key = MART_KEYS[name]
    text_key = key if name == "monthly_metrics" else f"CAST({key} AS VARCHAR)"
    casts = ""
    if name == "customer_analytics":
        casts = """ REPLACE (CAST(customer_unique_id AS VARCHAR) AS customer_unique_id,
                             CAST(customer_zip_code_prefix AS INTEGER) AS customer_zip_code_prefix)"""
    served = f"SELECT {text_key} AS _id, * EXCLUDE ({key}){casts} FROM"
    return _with(f"{served} (SELECT * FROM ({body}) ORDER BY {key} NULLS FIRST LIMIT {limit})", *views)



# What each kind of dirt by the key's last digit is read as; a customer without (readable) orders has no sales.
DIRTY_MART = f"""
    , mart AS ({CUSTOMER}),
    read AS (
      SELECT customer_id, customer_id % 10 AS d, avg_order_value,
        CASE WHEN d IN (1, 2, 3, 4) THEN 0 ELSE orders END AS n,
        CASE WHEN d IN (5, 6, 8, 9) THEN 0 ELSE total_spent END AS spent,
        CASE d WHEN 7 THEN NULL WHEN 8 THEN 25.0 ELSE avg_order_value END AS average,
        CASE d WHEN 5 THEN first_order::TIMESTAMP - INTERVAL 2 HOUR
          WHEN 6 THEN first_order::TIMESTAMP + INTERVAL 123456 MICROSECOND
          WHEN 7 THEN NULL ELSE date_trunc('day', first_order)::TIMESTAMP END AS first_order
      FROM mart
    )
    SELECT CAST(customer_id AS VARCHAR) AS _id, n AS orders, CASE WHEN n = 0 THEN 0.0 ELSE spent END::DOUBLE AS total_spent,
      CASE WHEN n = 0 THEN NULL ELSE average END::DOUBLE AS avg_order_value, CAST(first_order AS TIMESTAMP) AS first_order
    FROM read"""

NAMES = {
    "customers": "v_customers",
    "sellers": "v_sellers",
    "products": "v_products",
    "category_translation": "v_translations",
    "orders": "v_orders",
    "order_items": "v_items",
    "order_payments": "v_payments",
    "order_reviews": "v_reviews",
}

COLUMNS = {
    "customers": "customer_id customer_unique_id customer_zip_code_prefix customer_city customer_state",
    "sellers": "seller_id seller_zip_code_prefix seller_city seller_state",
    "products": "product_id product_category_name product_name_lenght product_description_lenght"
    " product_photos_qty product_weight_g product_length_cm product_height_cm product_width_cm",
    "category_translation": "product_category_name product_category_name_english",
    "orders": "order_id customer_id order_status order_purchase_timestamp order_approved_at"
    " order_delivered_carrier_date order_delivered_customer_date order_estimated_delivery_date",
    "order_items": "order_id order_item_id product_id seller_id shipping_limit_date price freight_value",
    "order_payments": "order_id payment_sequential payment_type payment_installments payment_value",
    "order_reviews": "review_id order_id review_score review_comment_title review_creation_date"
    " review_answer_timestamp",
}

KEYS = {
    "customers": ["customer_id"],
    "sellers": ["seller_id"],
    "products": ["product_id"],
    "orders": ["order_id"],
    "order_items": ["order_id", "order_item_id"],
    "order_payments": ["order_id", "payment_sequential"],
}

RELATIONS = [
    ("orders", "customers", "customer_id"),
    ("order_items", "orders", "order_id"),
    ("order_items", "products", "product_id"),
    ("order_items", "sellers", "seller_id"),
    ("order_payments", "orders", "order_id"),
    ("order_reviews", "orders", "order_id"),
]

RULES = [
    ("approved before purchase", "order_approved_at", "order_purchase_timestamp"),
    ("carrier before purchase", "order_delivered_carrier_date", "order_purchase_timestamp"),
    ("delivered before purchase", "order_delivered_customer_date", "order_purchase_timestamp"),
    ("delivered before carrier", "order_delivered_customer_date", "order_delivered_carrier_date"),
    ("estimated before purchase", "order_estimated_delivery_date", "order_purchase_timestamp"),
]


def _row_counts() -> str:
    parts = [f"SELECT '{n}' AS dataset, count(*) AS rows FROM {v}" for n, v in NAMES.items()]
    return _with("\n" + " UNION ALL ".join(parts), *NAMES.values())


def _missing() -> str:
    parts = [
        f"SELECT '{n}' AS dataset, '{c}' AS \"column\", "
        f"count(*) FILTER (WHERE coalesce(trim(CAST({c} AS VARCHAR)), '') = '') AS missing, count(*) AS n FROM {v}"
        for n, v in NAMES.items()
        for c in COLUMNS[n].split()
    ]
    body = " UNION ALL ".join(parts)
    select = 'SELECT dataset, "column", missing, missing / n * 100 AS percent'
    return _with(f"\n{select} FROM ({body}) WHERE missing > 0", *NAMES.values())


def _duplicates() -> str:
    parts = [
        f"SELECT '{n}' AS dataset, '{' + '.join(k)}' AS key, "
        f"count(*) - count(DISTINCT ({', '.join(k)})) AS duplicates FROM {NAMES[n]}"
        for n, k in KEYS.items()
    ]
    return _with("\n" + " UNION ALL ".join(parts), *[NAMES[n] for n in KEYS])


def _orphans() -> str:
    parts = [
        f"SELECT '{c} without {p}' AS relation, '{c}' AS child, '{p}' AS parent, '{k}' AS key, "
        f"(SELECT count(*) FROM {NAMES[c]} ANTI JOIN {NAMES[p]} USING ({k}) WHERE {k} IS NOT NULL) AS orphans"
        for c, p, k in RELATIONS
    ]
    return _with("\n" + " UNION ALL ".join(parts), *NAMES.values())


def _date_order() -> str:
    parts = [
        f"SELECT '{label}' AS rule, '{later}' AS later, '{earlier}' AS earlier, "
        f"count(*) FILTER (WHERE {later} < {earlier}) AS violations FROM v_orders"
        for label, later, earlier in RULES
    ]
    return _with("\n" + " UNION ALL ".join(parts), "v_orders")


def _unwound(view: str) -> str:
    return _with(f"\nSELECT * FROM {view} WHERE order_id IN (SELECT order_id FROM v_orders)", view, "v_orders")


DOCUMENTS_FLAT = """
    SELECT o.order_id AS _id, o.customer_id, o.order_status,
           coalesce(n_items, 0) AS n_items, coalesce(n_payments, 0) AS n_payments, coalesce(n_reviews, 0) AS n_reviews,
           coalesce(item_ids, 0) AS item_ids, coalesce(installments, 0) AS installments, coalesce(scores, 0) AS scores,
           coalesce(last_item, -1) AS last_item, first_payment, coalesce(last_review, -1) AS last_review
    FROM v_orders o
    LEFT JOIN (SELECT order_id, count(*) AS n_items, CAST(sum(order_item_id) AS BIGINT) AS item_ids,
                      max(order_item_id) AS last_item FROM v_items GROUP BY order_id) i ON i.order_id = o.order_id
    LEFT JOIN (SELECT order_id, count(*) AS n_payments, CAST(sum(payment_installments) AS BIGINT) AS installments,
                      arg_min(payment_type, payment_sequential) AS first_payment
               FROM v_payments GROUP BY order_id) p ON p.order_id = o.order_id
    LEFT JOIN (SELECT order_id, count(*) AS n_reviews, CAST(sum(review_score) AS BIGINT) AS scores,
                      arg_max(review_id, (review_creation_date, review_id)) AS last_review
               FROM v_reviews GROUP BY order_id) r ON r.order_id = o.order_id"""


def _page(order: str, where: str, limit: int, offset: int = 0) -> str:
    return _with(
        f"""
    SELECT row_number() OVER (ORDER BY {order}) AS position, *
    FROM (SELECT order_id AS _id, * EXCLUDE (order_id) FROM v_orders WHERE {where}
          ORDER BY {order} LIMIT {limit} OFFSET {offset})""",
        "v_orders",
    )


def _violations(view: str, key: str, required: list[str]) -> str:
    parts = [
        f"SELECT CAST({key} AS VARCHAR) AS _id, 'missing {c}' AS violation FROM {view} WHERE {c} IS NULL"
        for c in required
    ]
    return _with("\n" + " UNION ALL ".join(parts), view)


def oracle_sql(page_size: int, deep_page: int, after: int, one_order: int, one_customer: int) -> dict[str, str]:
    sql = {name: _with(body, *views) for name, (body, *views) in MART_SQL.items()}
    sql |= {f"{name}_top_n": _first_rows(name, 100) for name in MART_SQL}
    body, *views = MART_SQL["category_analytics"]
    sql["category_analytics_normalized"] = _with(
        f"\nSELECT category AS _id, * EXCLUDE (category) FROM ({body})", *views
    )
    sql["orders_by_status"] = _with(
        "\nSELECT order_status AS status, count(*) AS order_count FROM v_orders GROUP BY order_status", "v_orders"
    )
    sql["payments_by_type"] = _with(PAYMENTS, "v_payments", "v_orders")
    sql["payments_by_type_unwound"] = sql["payments_by_type"]
    sql["customers_load"] = _with(
        "\nSELECT customer_id AS _id, * EXCLUDE (customer_id) FROM v_customers", "v_customers"
    )
    sql["sellers_load"] = _with("\nSELECT seller_id AS _id, * EXCLUDE (seller_id) FROM v_sellers", "v_sellers")
    sql["products_enriched"] = _with(
        "\nSELECT v_products.*, product_category_name_english FROM v_products"
        " LEFT JOIN v_translations USING (product_category_name)",
        "v_products",
        "v_translations",
    )
    sql["orders_typed"] = _with("\nSELECT * FROM v_orders", "v_orders")
    sql["order_items_load"] = _with("\nSELECT * FROM v_items", "v_items")
    sql["order_payments_load"] = _with("\nSELECT * FROM v_payments", "v_payments")
    sql["order_reviews_typed"] = _with("\nSELECT * FROM v_reviews", "v_reviews")
    sql["review_dates_cleaned"] = _with(
        "\nSELECT review_id, review_comment_title, review_creation_date,"
        " CAST(CAST(review_answer_timestamp AS DATE) AS TIMESTAMP) AS review_answer_timestamp FROM v_reviews",
        "v_reviews",
    )
    sql["order_documents_flat"] = _with(DOCUMENTS_FLAT, "v_orders", "v_items", "v_payments", "v_reviews")
    sql["order_items_unwound"] = _unwound("v_items")
    sql["order_payments_unwound"] = _unwound("v_payments")
    sql["order_reviews_unwound"] = _unwound("v_reviews")
    sql["dq_row_counts"] = _row_counts()
    sql["dq_missing_values"] = _missing()
    sql["dq_duplicate_keys"] = _duplicates()
    sql["dq_orphans"] = _orphans()
    sql["dq_date_order"] = _date_order()
    sql["dq_findings"] = f"""
    SELECT 'rows' AS section, dataset, '' AS name, rows AS value FROM ({_row_counts()})
    UNION ALL SELECT 'missing', dataset, "column", missing FROM ({_missing()})
    UNION ALL SELECT 'dates', 'orders', rule, violations FROM ({_date_order()})
    UNION ALL SELECT 'duplicates', dataset, key, duplicates FROM ({_duplicates()})
    UNION ALL SELECT 'orphans', child, relation, orphans FROM ({_orphans()})"""
    body, *views = MART_SQL["geography_analytics"]
    sql["geography_analytics_sorted"] = _with(
        f"\nSELECT *, row_number() OVER (ORDER BY state NULLS LAST) AS position FROM ({body})", *views
    )
    sql["orders_page_offset"] = _page("_id", "order_status = 'delivered'", page_size, 2 * page_size)
    sql["orders_page_deep"] = _page("_id", "TRUE", page_size, (deep_page - 1) * page_size)
    sql["orders_page_keyset"] = _page("_id", f"order_id > {after}", page_size)
    sql["orders_page_envelope"] = _with(
        f"\nSELECT count(*) AS total, CAST(2 AS BIGINT) AS page, CAST({page_size} AS BIGINT) AS size,"
        f" greatest(CAST(ceil(count(*) / {page_size}) AS BIGINT), 1) AS total_pages"
        " FROM v_orders WHERE order_status = 'delivered'",
        "v_orders",
    )
    for name in ("orders_page_offset", "orders_page_deep", "orders_page_keyset", "orders_page_envelope"):
        sql[f"{name}_built"] = sql[name]
    as_text = "CAST(order_id AS VARCHAR) AS order_id"
    sql["orders_contract"] = _with(
        "\nSELECT CAST(order_id AS VARCHAR) AS _id, o.* EXCLUDE (order_id)"
        " REPLACE (CAST(customer_id AS VARCHAR) AS customer_id),"
        " (SELECT count(*) FROM v_items x WHERE x.order_id = o.order_id) AS items,"
        " (SELECT count(*) FROM v_payments x WHERE x.order_id = o.order_id) AS payments,"
        " (SELECT count(*) FROM v_reviews x WHERE x.order_id = o.order_id) AS reviews FROM v_orders o",
        "v_orders",
        "v_items",
        "v_payments",
        "v_reviews",
    )
    sql["orders_from_csv"] = _with(
        f"\nSELECT * REPLACE ({as_text}, CAST(customer_id AS VARCHAR) AS customer_id) FROM v_orders", "v_orders"
    )
    sql["items_from_csv"] = _with(
        f"\nSELECT * REPLACE ({as_text}, CAST(product_id AS VARCHAR) AS product_id,"
        " CAST(seller_id AS VARCHAR) AS seller_id) FROM v_items",
        "v_items",
    )
    sql["texts_from_csv"] = (
        "SELECT CAST(doc_id AS VARCHAR) AS review_id, CAST(doc_id % 5 + 1 AS BIGINT) AS review_score,"
        " lang AS review_comment_title, text AS review_comment_message FROM documents"
    )
    sql["texts_from_csv_split"] = sql["texts_from_csv"]
    sql["order_by_id"] = _with(
        f"\nSELECT order_id AS _id, * EXCLUDE (order_id) FROM v_orders WHERE order_id = {one_order}", "v_orders"
    )
    sql["orders_by_customer"] = _page(
        "order_purchase_timestamp DESC, _id", f"customer_id = {one_customer}", page_size
    )
    for name in ("order_by_id", "orders_by_customer", "customer_analytics_top_n"):
        sql[f"{name}_built"] = sql[name]
    sql["landed_drift"] = """
    SELECT * FROM (VALUES
      ('orders', 'order_status', 'missing', TRUE),
      ('orders', 'status', 'not in the catalog', FALSE),
      ('order_items', 'price', 'string instead of double', TRUE)
    ) t("dataset", "column", "problem", "harmful")"""
    sql["customer_analytics_dirty"] = _with(DIRTY_MART, "v_customers", "v_orders", "order_money")
    sql["order_violations"] = _with(
        """
    SELECT order_id AS _id, 'missing customer' AS violation FROM v_orders WHERE order_id % 7 = 0 OR customer_id IS NULL
    UNION ALL SELECT order_id, 'unknown status' FROM v_orders WHERE order_id % 11 IN (0, 1) OR order_status IS NULL
      OR order_status NOT IN ('created', 'approved', 'processing', 'invoiced', 'shipped', 'delivered', 'unavailable', 'canceled')
    UNION ALL SELECT order_id, 'missing items' FROM v_orders WHERE order_id % 13 = 0
    UNION ALL SELECT order_id, 'missing reviews' FROM v_orders WHERE order_id % 17 = 0""",
        "v_orders",
    )
    sql["customers_contract"] = _with(
        "\nSELECT CAST(customer_id AS VARCHAR) AS _id, CAST(customer_unique_id AS VARCHAR) AS customer_unique_id,"
        " CAST(customer_zip_code_prefix AS INTEGER) AS customer_zip_code_prefix, customer_city, customer_state"
        " FROM v_customers",
        "v_customers",
    )
    sql["sellers_contract"] = _with(
        "\nSELECT CAST(seller_id AS VARCHAR) AS _id, CAST(seller_zip_code_prefix AS INTEGER) AS seller_zip_code_prefix,"
        " seller_city, seller_state FROM v_sellers",
        "v_sellers",
    )
    sql["products_contract"] = _with(
        "\nSELECT CAST(product_id AS VARCHAR) AS _id, product_category_name, product_category_name_english,"
        " CAST(product_name_lenght AS INTEGER) AS product_name_lenght,"
        " CAST(product_description_lenght AS INTEGER) AS product_description_lenght,"
        " CAST(product_photos_qty AS INTEGER) AS product_photos_qty,"
        " CAST(product_weight_g AS DOUBLE) AS product_weight_g, CAST(product_length_cm AS DOUBLE) AS product_length_cm,"
        " CAST(product_height_cm AS DOUBLE) AS product_height_cm, CAST(product_width_cm AS DOUBLE) AS product_width_cm"
        " FROM v_products LEFT JOIN v_translations USING (product_category_name)",
        "v_products",
        "v_translations",
    )
    sql["customers_violations"] = _violations(
        "v_customers",
        "customer_id",
        ["customer_id", "customer_unique_id", "customer_zip_code_prefix", "customer_city", "customer_state"],
    )
    return sql
