"""The registered queries as SQL for DuckDB, written from the rules alone.

DuckDB rounds on integer casts, so whole numbers are made with ``floor`` and
``trunc``; decimal literals in double formulas are cast to double.
"""

from __future__ import annotations


def r2(x: str) -> str:
    return f"(floor(({x}) * 100 + 0.5) / 100)"


def exact(x: str, scale: int = 100) -> str:
    """Order-independent sum, as a double."""
    return f"(CAST(sum(CAST(floor(({x}) * {scale} + 0.5) AS BIGINT)) AS DOUBLE) / {scale})"


def mean(x: str) -> str:
    return f"({exact(x)} / nullif(count({x}), 0))"


def _id(prefix: str, number: str) -> str:
    text = f"CAST({number} AS VARCHAR)"
    return f"'{prefix}' || lpad({text}, CAST(greatest(3, length({text})) AS INTEGER), '0')"


STORE, PRODUCT = "user_id % 5 + 1", "CAST(json_extract_string(props, '$.k') AS BIGINT) % 50 + 1"


def _category(number: str) -> str:
    return f"""CASE WHEN {number} BETWEEN 1 AND 10 THEN 'Rice' WHEN {number} BETWEEN 11 AND 20 THEN 'Snacks'
        WHEN {number} BETWEEN 21 AND 30 THEN 'Beverages' WHEN {number} BETWEEN 31 AND 40 THEN 'Dairy'
        WHEN {number} BETWEEN 41 AND 50 THEN 'Personal Care' ELSE 'General' END"""


def windows(source: str, window: int, slide: int, counted: str = "true") -> str:
    """Sliding windows aligned to the epoch, in seconds."""
    first = f"(epoch_us(event_time) // {slide * 1000000}) * {slide} - i * {slide}"
    return f"""
    SELECT make_timestamp(start * 1000000) AS window_start,
           make_timestamp((start + {window}) * 1000000) AS window_end,
           store_id, product_id,
           CAST(sum(quantity) AS BIGINT) AS total_units_sold,
           {r2('sum(quantity * unit_price)')} AS total_revenue,
           {r2(f'CAST(sum(quantity) * 60 AS DOUBLE) / {window}')} AS avg_units_per_minute,
           count(*) AS transaction_count
    FROM (SELECT *, {first} AS start FROM {source}, range({-(-window // slide)}) t(i)
          WHERE event_time IS NOT NULL)
    WHERE epoch_us(event_time) < (start + {window}) * 1000000 AND {counted}
    GROUP BY start, store_id, product_id"""


METRICS = ("total_units_sold", "total_revenue", "avg_units_per_minute", "transaction_count")
MAXIMA = ", ".join(f"max({m}) AS {m}" for m in METRICS)


def _stocked(skus: str) -> str:
    return f"""
    SELECT {_id('STORE_', 'store')} AS store_id, {_id('PROD_', 'product')} AS product_id,
           CAST((product * 37 + store * 11) % 200 AS INTEGER) AS current_stock,
           CAST(2 + (product + store) % 3 AS INTEGER) AS lead_time_days
    FROM ({skus})"""


# A fixed linear prediction in the place of a forest.
LINEAR = """(coalesce(total_units_sold, 0) * CAST(2.5 AS DOUBLE)
    + coalesce(transaction_count, 0) * CAST(0.25 AS DOUBLE) + 1)"""


def _health(inventory: str, source: str, window: int, prediction: str | None = None) -> str:
    demand = r2(f"CAST(coalesce(total_units_sold, 0) * 86400 AS DOUBLE) / {window}")
    if prediction:
        demand = f"greatest({r2(f'{prediction} * (CAST(86400 AS DOUBLE) / {window})')}, {demand})"
    return f"""
    SELECT *, CASE WHEN days_of_cover <= 1 THEN 'CRITICAL' WHEN days_of_cover <= 2 THEN 'HIGH'
                   WHEN days_of_cover <= 4 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
           greatest(0, CAST(trunc(predicted_daily_demand * (lead_time_days + 2)) AS BIGINT) - current_stock)
               AS recommended_reorder_quantity
    FROM (SELECT *, {r2('current_stock / greatest(predicted_daily_demand, 1)')} AS days_of_cover
          FROM (SELECT store_id, product_id, current_stock, lead_time_days,
                       {demand} AS predicted_daily_demand,
                       CAST(coalesce(total_units_sold, 0) AS DOUBLE) AS actual_sales
                FROM {inventory} LEFT JOIN {source} USING (store_id, product_id)))"""


def _decisions(inventory: str, source: str, window: int, prediction: str | None = None) -> str:
    demand = f"CAST(total_units_sold * 86400 AS DOUBLE) / {window}"
    if prediction:
        demand = f"{prediction} * (CAST(86400 AS DOUBLE) / {window})"
    short = "predicted_daily_demand * (lead_time_days + 2) - current_stock"
    return f"""
    SELECT store_id, product_id, current_stock, predicted_daily_demand, stock_out_risk,
           CASE WHEN {short} > 0 THEN floor({short} + 0.5) ELSE CAST(0 AS DOUBLE) END
               AS recommended_reorder_quantity,
           CASE stock_out_risk WHEN 'HIGH' THEN 'REORDER' WHEN 'MEDIUM' THEN 'MONITOR'
                ELSE 'NO_ACTION' END AS action
    FROM (SELECT *, CASE WHEN current_stock < predicted_daily_demand * lead_time_days THEN 'HIGH'
                         WHEN current_stock < predicted_daily_demand * (lead_time_days + 1) THEN 'MEDIUM'
                         ELSE 'LOW' END AS stock_out_risk
          FROM (SELECT *, {r2(demand)} AS predicted_daily_demand
                FROM {inventory} JOIN {source} USING (store_id, product_id)))"""


def _daily(source: str, window: int) -> str:
    return f"""
    SELECT CAST(window_start AS DATE) AS day, store_id, product_id,
           CAST(sum(total_units_sold) AS BIGINT) AS units, {exact('total_revenue')} AS revenue,
           {r2(f'CAST(max(total_units_sold) * 86400 AS DOUBLE) / {window}')} AS demand
    FROM {source} GROUP BY ALL"""


def _daily_trend(source: str, inventory: str) -> str:
    cover = r2("current_stock / greatest(demand, 1)")
    return f"""
    SELECT strftime(day, '%Y-%m-%d') AS date, CAST(sum(units) AS BIGINT) AS units,
           {exact('revenue')} AS revenue, {exact('demand')} AS demand,
           count(*) FILTER (current_stock IS NOT NULL AND {cover} <= 2) AS at_risk
    FROM {source} LEFT JOIN {inventory} USING (store_id, product_id) GROUP BY day"""


def _scaffold(source: str, days: int) -> str:
    factor = f"(CAST(0.88 AS DOUBLE) + CAST(0.02 AS DOUBLE) * ({days} - i))"
    return f"""
    SELECT strftime(DATE '2024-01-28' - CAST(i AS INTEGER), '%Y-%m-%d') AS date, series,
           {r2(f'total * {factor}')} AS value
    FROM (SELECT 'sales_rate' AS series, {exact('actual_sales')} AS total FROM {source}
          UNION ALL SELECT 'demand_rate', {exact('predicted_daily_demand')} FROM {source}
          UNION ALL SELECT 'reorder_rate',
                 CAST(count(*) FILTER (risk_level IN ('HIGH', 'CRITICAL')) AS DOUBLE) FROM {source}),
         range({days}) t(i)"""


SLICED = """
    SELECT *, least(floor((epoch_us(event_time) - lo) * 4 / CAST(hi - lo + 1 AS DOUBLE)), 3) AS slice
    FROM {}, (SELECT epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM events)"""
# Rows of the first slice that come with the last count in windows that had not closed
# two slices before.
LATE_COUNTS = """(slice > 0 OR event_id % 10 > 0 OR make_timestamp((start + {}) * 1000000) >
    (SELECT max(event_time) FROM sliced WHERE slice = 1) - INTERVAL 10 MINUTE)"""

PARSED = """CAST(TRY_CAST(json_extract_string(j, '$.event_time') AS TIMESTAMP) AS TIMESTAMP) AS event_time,
           json_extract_string(j, '$.store_id') AS store_id,
           json_extract_string(j, '$.product_id') AS product_id,
           json_extract_string(j, '$.category') AS category,
           CASE WHEN json_type(j, '$.unit_price') IN ('DOUBLE', 'BIGINT', 'UBIGINT')
                THEN CAST(json_extract_string(j, '$.unit_price') AS DOUBLE) END AS unit_price,
           CASE WHEN json_type(j, '$.quantity') IN ('BIGINT', 'UBIGINT')
                THEN CAST(json_extract_string(j, '$.quantity') AS INTEGER) END AS quantity,
           json_extract_string(j, '$.payment_mode') AS payment_mode,
           CAST(json_extract_string(j, '$.is_anomaly') AS BOOLEAN) AS is_anomaly"""
UNREADABLE = """coalesce(store_id, product_id, category, payment_mode, CAST(event_time AS VARCHAR),
    CAST(unit_price AS VARCHAR), CAST(quantity AS VARCHAR), CAST(is_anomaly AS VARCHAR)) IS NULL"""
NOT_VALID = "coalesce(NOT ({} > 0), true)"

# name -> (relations it reads, SQL)
RELATIONS: dict[str, tuple[tuple[str, ...], str]] = {
    "sales": ((), f"""
    SELECT event_id, ts AS event_time, {_id('STORE_', f'({STORE})')} AS store_id,
           {_id('PROD_', f'({PRODUCT})')} AS product_id, {_category(f'({PRODUCT})')} AS category,
           value AS unit_price,
           CAST(CASE WHEN event_id % 97 = 0 THEN 0 ELSE event_id % 5 + 1 END AS INTEGER) AS quantity,
           CASE event_id % 3 WHEN 0 THEN 'UPI' WHEN 1 THEN 'Card' ELSE 'Cash' END AS payment_mode,
           event_type = 'error' AS is_anomaly
    FROM events"""),
    "valid": (("sales",), "SELECT * FROM sales WHERE unit_price > 0 AND quantity > 0"),
    "texts": (("sales",), """
    SELECT event_id, CAST(json_object(
        'event_time', CASE WHEN event_id % 83 = 2 THEN 'garbage'
            WHEN event_id % 71 <> 5 THEN strftime(event_time, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' END,
        'store_id', CASE WHEN event_id % 101 <> 6 THEN store_id END,
        'product_id', product_id, 'category', category,
        'unit_price', CASE WHEN event_id % 67 = 6 THEN -unit_price ELSE unit_price END,
        'quantity', quantity, 'payment_mode', payment_mode, 'is_anomaly', is_anomaly) AS VARCHAR) AS text
    FROM sales"""),
    "lines": (("texts",), """
    SELECT event_id, CASE WHEN event_id % 89 = 1 THEN left(text, length(text) - 9)
        WHEN event_id % 73 = 4 THEN regexp_replace(text, '"unit_price":([^,]+)', '"unit_price":"\\1"')
        WHEN event_id % 79 = 3 THEN regexp_replace(text, '"quantity":\\d+', '"quantity":1.5')
        WHEN event_id % 59 = 8 OR event_id % 61 = 9 OR event_id % 53 = 10
            THEN regexp_replace(text, '"unit_price":[^,]+', '"unit_price":null')
        WHEN event_id % 103 = 11 THEN '{}' WHEN event_id % 107 = 12 THEN '{"unit_price": 5}'
        ELSE text END AS value
    FROM texts"""),
    "parsed": (("lines",), f"""
    SELECT {PARSED}
    FROM (SELECT CASE WHEN json_valid(value) THEN value END AS j FROM lines)"""),
    "letters": (("lines",), """
    SELECT event_id, CASE WHEN json_valid(value) THEN value END AS j, value,
           CASE WHEN NOT json_valid(value) THEN true
                ELSE coalesce(json_type(value, '$.unit_price') = 'VARCHAR', false)
                     OR coalesce(json_type(value, '$.quantity') = 'DOUBLE', false) END AS corrupt
    FROM lines"""),
    "refused": (("letters",), f"""
    SELECT *, CASE WHEN corrupt AND j IS NULL THEN 'bad_json' WHEN corrupt THEN 'bad_field'
                   WHEN {UNREADABLE} THEN 'no_fields' WHEN event_time IS NULL THEN 'bad_time'
                   WHEN {NOT_VALID.format('unit_price')} THEN 'bad_price'
                   WHEN {NOT_VALID.format('quantity')} THEN 'bad_quantity' END AS reason
    FROM (SELECT event_id, corrupt, value, j, {PARSED} FROM letters)
    WHERE reason IS NOT NULL"""),
    "parsed_valid": (("parsed",), "SELECT * FROM parsed WHERE unit_price > 0 AND quantity > 0"),
    "sales_li": ((), f"""
    SELECT l_shipdate AS event_time, {_id('STORE_', 'l_suppkey')} AS store_id,
           {_id('PROD_', 'l_partkey')} AS product_id, l_extendedprice / l_quantity AS unit_price,
           CAST(trunc(l_quantity) AS INTEGER) AS quantity
    FROM lineitem"""),
    "valid_li": (("sales_li",), "SELECT * FROM sales_li WHERE unit_price > 0 AND quantity > 0"),
    "win_6h": (("valid",), windows("valid", 21600, 3600)),
    "gaps": (("win_6h",), """
    SELECT * REPLACE (CASE WHEN transaction_count % 5 <> 0 THEN total_units_sold END AS total_units_sold,
                      CASE WHEN total_units_sold % 7 <> 0 THEN total_revenue END AS total_revenue)
    FROM win_6h"""),
    "closed_6h": (("valid", "win_6h"), """
    SELECT * FROM win_6h
    WHERE window_end <= (SELECT max(event_time) FROM valid) - INTERVAL 10 MINUTE"""),
    "sku_closed": (("closed_6h",), f"SELECT store_id, product_id, {MAXIMA} FROM closed_6h GROUP BY ALL"),
    "sliced": (("valid",), SLICED.format("valid")),
    "closed_late": (("sliced",), f"""
    SELECT * FROM ({windows("sliced", 12 * 86400, 86400, LATE_COUNTS.format(12 * 86400))})
    WHERE window_end <= (SELECT max(event_time) FROM valid) - INTERVAL 10 MINUTE"""),
    "inventory_more": (("inventory",), """
    SELECT store_id, product_id, lead_time_days,
           CAST(current_stock + CASE lead_time_days WHEN 3 THEN 50 ELSE 0 END AS INTEGER) AS current_stock
    FROM inventory WHERE current_stock % 7 <> 0"""),
    "decided_more": (("inventory_more", "sku_closed"), _decisions("inventory_more", "sku_closed", 21600)),
    "win_1h": (("valid",), windows("valid", 3600, 3600)),
    "win_1d": (("valid_li",), windows("valid_li", 86400, 86400)),
    "sku_6h": (("win_6h",), f"SELECT store_id, product_id, {MAXIMA} FROM win_6h GROUP BY ALL"),
    "sku_1d": (("win_1d",), f"SELECT store_id, product_id, {MAXIMA} FROM win_1d GROUP BY ALL"),
    "inventory": ((), _stocked(f"""
        SELECT DISTINCT {STORE} AS store, {PRODUCT} AS product FROM events
        UNION ALL SELECT s_suppkey % 5 + 1, s_suppkey + 51 FROM supplier""")),
    "inventory_li": ((), _stocked("""
        SELECT l_suppkey AS store, l_partkey AS product FROM lineitem
        UNION SELECT p_partkey % 10, p_partkey FROM part""")),
    "sellers_li": ((), f"""
    SELECT {_id('STORE_', 'store')} AS store_id, {_id('PROD_', 'product')} AS product_id,
           s_name AS seller_name, 'desk-' || store || '-' || product AS seller_contact,
           CASE (store + product) % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'FALSE' ELSE ' True ' END
               AS auto_confirm_eligible
    FROM (SELECT DISTINCT l_suppkey AS store, l_partkey AS product FROM lineitem)
    JOIN supplier ON store = s_suppkey"""),
    "updates": ((), f"""
    SELECT CASE WHEN o_orderpriority = '2-HIGH' THEN '  ' ELSE '' END
               || {_id('STORE_', '(o_orderkey % 10)')} AS store_id,
           CASE WHEN o_orderpriority = '5-LOW' THEN '  ' ELSE {_id('PROD_', 'o_custkey')} END AS product_id,
           CAST(CASE WHEN o_orderpriority = '1-URGENT' THEN -1
                ELSE CAST(floor(o_totalprice) AS BIGINT) % 500 END AS INTEGER) AS current_stock,
           o_orderdate AS updated_at
    FROM orders"""),
    "upserted": (("inventory_li", "updates"), """
    SELECT store_id, product_id, coalesce(new_stock, current_stock) AS current_stock,
           CASE WHEN current_stock IS NULL THEN 3 ELSE lead_time_days END AS lead_time_days,
           CASE WHEN new_stock IS NULL THEN 'unchanged' WHEN current_stock IS NULL THEN 'created'
                ELSE 'updated' END AS status
    FROM inventory_li FULL JOIN (
        SELECT trim(store_id) AS store_id, trim(product_id) AS product_id, current_stock AS new_stock
        FROM updates
        WHERE trim(product_id) <> '' AND trim(store_id) <> '' AND current_stock >= 0
        QUALIFY row_number() OVER (PARTITION BY trim(store_id), trim(product_id)
                                   ORDER BY updated_at DESC, current_stock DESC) = 1)
    USING (store_id, product_id)"""),
    "health": (("inventory", "sku_6h"), _health("inventory", "sku_6h", 21600)),
    "health_model": (("inventory", "sku_6h"), _health("inventory", "sku_6h", 21600, LINEAR)),
    "health_li": (("inventory_li", "sku_1d"), _health("inventory_li", "sku_1d", 86400)),
    "idle": (("sku_1d",), "SELECT * FROM sku_1d WHERE false"),
    "health_idle": (("inventory_li", "idle"), _health("inventory_li", "idle", 86400)),
    "decided": (("inventory_li", "sku_1d"), _decisions("inventory_li", "sku_1d", 86400)),
    "decided_model": (("inventory", "sku_6h"), _decisions("inventory", "sku_6h", 21600, LINEAR)),
    "decided_6h": (("inventory", "sku_6h"), _decisions("inventory", "sku_6h", 21600)),
    "decided_closed": (("inventory", "sku_closed"), _decisions("inventory", "sku_closed", 21600)),
    "reorders": (("health_li", "sellers_li"), """
    SELECT store_id, product_id, risk_level, recommended_reorder_quantity,
           coalesce(seller_name, 'Seller Not Mapped') AS seller_name,
           coalesce(seller_contact, 'NA') AS seller_contact, 'CREATE_DRAFT_PO' AS action,
           coalesce(lower(trim(auto_confirm_eligible)) = 'true', false) AS auto_confirm_eligible,
           'pending' AS status, CAST(NULL AS VARCHAR) AS last_reorder_date, current_stock,
           predicted_daily_demand, days_of_cover
    FROM health_li LEFT JOIN sellers_li USING (store_id, product_id)
    WHERE risk_level IN ('HIGH', 'CRITICAL')"""),
    "predictions": (("health_li",), """
    SELECT store_id, product_id, '2024-01-31' AS date, predicted_daily_demand AS predicted_demand,
           actual_sales AS actual_demand, CAST(0.85 AS DOUBLE) AS confidence
    FROM health_li"""),
    "daily": (("win_1h",), _daily("win_1h", 3600)),
    "daily_li": (("win_1d",), _daily("win_1d", 86400)),
    "daily_predictions": (("daily",), """
    SELECT s.store_id, s.product_id, strftime(s.day, '%Y-%m-%d') AS date, predicted_demand,
           CAST(units AS DOUBLE) AS actual_demand
    FROM (SELECT store_id, product_id, predicted_demand,
                 CAST(unnest(generate_series(first_day, last_day, INTERVAL 1 DAY)) AS DATE) AS day
          FROM (SELECT store_id, product_id, max(demand) AS predicted_demand, min(day) AS first_day,
                       max(day) AS last_day
                FROM daily GROUP BY store_id, product_id)) s LEFT JOIN daily USING (store_id, product_id, day)"""),
    "next_6h": (("win_6h",), """
    SELECT w.*, coalesce(n.total_units_sold, 0) AS next_units
    FROM win_6h w LEFT JOIN win_6h n ON n.store_id = w.store_id AND n.product_id = w.product_id
                                    AND n.window_start = w.window_end"""),
    "flagged_li": (("sales_li",), f"""
    SELECT *, price_spike OR bulk_quantity AS rule_anomaly
    FROM (SELECT *, quantity >= 10 AS bulk_quantity,
                 unit_price >= 2 * CASE category WHEN 'Rice' THEN 120 WHEN 'Snacks' THEN 60
                     WHEN 'Beverages' THEN 80 WHEN 'Dairy' THEN 90 WHEN 'Personal Care' THEN 150
                     ELSE 100 END AS price_spike
          FROM (SELECT *, {_category("CAST(split_part(product_id, '_', 2) AS BIGINT)")} AS category
                FROM sales_li))"""),
    "flagged": (("sales",), """
    SELECT *, price_spike OR bulk_quantity AS rule_anomaly
    FROM (SELECT * EXCLUDE (event_id), quantity >= 10 AS bulk_quantity,
                 unit_price >= 2 * CASE category WHEN 'Rice' THEN 120 WHEN 'Snacks' THEN 60
                     WHEN 'Beverages' THEN 80 WHEN 'Dairy' THEN 90 WHEN 'Personal Care' THEN 150
                     ELSE 100 END AS price_spike
          FROM sales)"""),
}


def _sql(body: str, *reads: str) -> str:
    """``body`` with the relations it needs as common table expressions."""
    needed: dict[str, str] = {}

    def add(name: str) -> None:
        parents, text = RELATIONS[name]
        for parent in parents:
            add(parent)
        needed.setdefault(name, text)

    for name in reads:
        add(name)
    ctes = ",\n".join(f"{name} AS ({text})" for name, text in needed.items())
    return f"WITH {ctes}\n{body}" if ctes else body


def _all(name: str, columns: str = "*", rest: str = "") -> str:
    return _sql(f"SELECT {columns} FROM {name} {rest}", name)


def _percent(part: str, whole: str) -> str:
    return r2(f"{part} / greatest({whole}, 1) * 100")


AT_RISK = "count(*) FILTER (risk_level IN ('HIGH', 'CRITICAL'))"
DECIDED_COUNTS = "count(*) AS count FROM decided GROUP BY ALL"
IS_TEST = """substr(md5(store_id || '|' || product_id || '|' ||
                      CAST(epoch_us(window_start) // 1000000 AS VARCHAR)), 1, 4) < '3333'"""
UPDATED_COLUMNS = "store_id, product_id, current_stock, lead_time_days"

ORACLE: dict[str, str] = {
    "parse_json_events": _all("parsed"),
    "valid_sales": _all("parsed_valid"),
    "rejected_sales": _sql(f"""
    SELECT * FROM (
        SELECT *, CASE WHEN {UNREADABLE} THEN 'bad_json'
                       WHEN event_time IS NULL THEN 'bad_time'
                       WHEN {NOT_VALID.format('unit_price')} THEN 'bad_price'
                       WHEN {NOT_VALID.format('quantity')} THEN 'bad_quantity' END AS reason
        FROM parsed)
    WHERE reason IS NOT NULL""", "parsed"),
    "dead_letters": _all("refused", """event_id AS "offset", reason, corrupt, event_time, store_id,
           product_id, category, unit_price, quantity, payment_mode, is_anomaly,
           regexp_extract(value, '"payment_mode":"([A-Za-z]+)"', 1) AS line_mode"""),
    "stream_dead_letters": _all("refused", "reason, count(*) AS lines, count(*) AS placed", "GROUP BY reason"),
    "stream_late_report": _sql(f"""
    SELECT CAST(slice AS BIGINT) AS batch_id, rows_in, valid,
           CASE WHEN slice = 3 THEN late ELSE 0 END AS late
    FROM (SELECT CASE WHEN slice = 0 AND event_id % 10 = 0 THEN 3 ELSE slice END AS slice,
                 count(*) AS rows_in, count(*) FILTER (unit_price > 0 AND quantity > 0) AS valid
          FROM ({SLICED.format('sales')}) GROUP BY 1),
         (SELECT count(*) AS late FROM (
              SELECT DISTINCT start, store_id, product_id
              FROM (SELECT *, (epoch_us(event_time) // 86400000000) * 86400 - i * 86400 AS start
                    FROM sliced, range(12) t(i))
              WHERE NOT {LATE_COUNTS.format(12 * 86400)}))""", "sales", "sliced"),
    "event_quality": _sql(f"""
    SELECT count(*) AS events,
           count(*) FILTER ({UNREADABLE}) AS unreadable,
           count(*) - count(event_time) AS null_time, count(*) - count(store_id) AS null_store,
           count(*) - count(product_id) AS null_product, count(*) - count(unit_price) AS null_price,
           count(*) FILTER (unit_price <= 0) AS nonpositive_price,
           count(*) - count(quantity) AS null_quantity,
           count(*) FILTER (quantity <= 0) AS nonpositive_quantity,
           count(*) FILTER (unit_price > 0 AND quantity > 0) AS valid
    FROM parsed""", "parsed"),
    "flag_anomalies": _all("flagged"),
    "flag_anomalies_li": _all("flagged_li"),
    "anomaly_shares": _sql(f"""
    SELECT *, {_percent('rule_anomalies', 'events')} AS anomaly_percent,
           {_percent('agreeing', 'events')} AS agreement_percent
    FROM (SELECT store_id, product_id, count(*) AS events,
                 count(*) FILTER (rule_anomaly) AS rule_anomalies,
                 count(*) FILTER (is_anomaly) AS producer_anomalies,
                 count(*) FILTER (rule_anomaly = is_anomaly) AS agreeing
          FROM flagged GROUP BY ALL)""", "flagged"),
    "category_sales": _sql(f"""
    SELECT category, CAST(sum(quantity) AS BIGINT) AS total_units_sold,
           {r2('sum(quantity * unit_price)')} AS total_revenue, count(*) AS transaction_count
    FROM valid GROUP BY category""", "valid"),
    "window_sales_5m_1m": _sql(windows("valid", 300, 60), "valid"),
    "window_sales_30s_10s": _sql(windows("valid", 30, 10), "valid"),
    "window_sales_6h_1h": _all("win_6h"),
    "window_sales_direct": _all("win_6h"),
    "window_sales_35d_7d": _sql(windows("valid_li", 35 * 86400, 7 * 86400), "valid_li"),
    "window_sales_1d": _all("win_1d"),
    "window_sales_from_json": _sql(windows("parsed_valid", 21600, 3600), "parsed_valid"),
    "latest_windows": _all("win_1d", rest="""
    QUALIFY row_number() OVER (PARTITION BY store_id, product_id ORDER BY window_start DESC) = 1"""),
    "next_window_labels": _all("next_6h"),
    "next_observed_labels": _all("win_1d", """*, lead(total_units_sold) OVER (
        PARTITION BY store_id, product_id ORDER BY window_start) AS next_units"""),
    "store_windows": _all("win_6h", rest="WHERE store_id = 'STORE_003'"),
    "recent_windows": _all(
        "win_1d", rest="WHERE store_id = 'STORE_001' ORDER BY window_start DESC, product_id LIMIT 10"
    ),
    "sku_features_max": _all("sku_1d"),
    "sku_features_latest": _all(
        "win_6h", "store_id, product_id, " + ", ".join(METRICS), """
    QUALIFY row_number() OVER (PARTITION BY store_id, product_id ORDER BY window_start DESC) = 1"""
    ),
    "inventory_demand_inner": _sql(
        "SELECT * FROM inventory_li JOIN sku_1d USING (store_id, product_id)", "inventory_li", "sku_1d"
    ),
    "inventory_demand_left": _sql(f"""
    SELECT store_id, product_id, current_stock, lead_time_days,
           {', '.join(f'coalesce({m}, 0) AS {m}' for m in METRICS)}
    FROM inventory_li LEFT JOIN sku_1d USING (store_id, product_id)""", "inventory_li", "sku_1d"),
    "sku_health": _all("health"),
    "sku_health_li": _all("health_li"),
    "sku_health_no_demand": _all("health_idle"),
    "sku_health_model": _all("health_model"),
    "decision_table_model": _all("decided_model"),
    "sku_features_prediction": _all("win_6h", f"store_id, product_id, {MAXIMA}, max({LINEAR}) AS prediction",
        "GROUP BY ALL"),
    "sku_features_avg": _all("win_6h", "store_id, product_id, "
        + ", ".join(f"{mean(m)} AS {m}" for m in METRICS), "GROUP BY store_id, product_id"),
    "rf_metrics": _sql(f"""
    SELECT count(*) AS rows, true AS rmse_covers_mae, true AS has_error, true AS r2_below_one
    FROM next_6h WHERE {IS_TEST}""", "next_6h"),
    "rf_importances": f"""
    SELECT '{",".join(sorted(METRICS))}' AS features, true AS shares, true AS sum_to_one""",
    "rf_scored_health": _sql("""
    SELECT 'success' AS status, count(*) AS skus, CAST(0 AS BIGINT) AS out_of_range,
           CAST(0 AS BIGINT) AS below_rate, CAST(2 AS BIGINT) AS records
    FROM inventory""", "inventory"),
    "decision_table_6h": _all("decided_6h"),
    "decision_table_li": _all("decided"),
    "decisions_by_priority": _all("decided_6h"),
    "inventory_upsert": _all("upserted"),
    "rejected_updates": _all("updates", """trim(store_id) AS store_id, trim(product_id) AS product_id,
           current_stock, updated_at,
           CASE WHEN trim(store_id) = '' THEN 'no_store' WHEN trim(product_id) = '' THEN 'no_product'
                ELSE 'bad_stock' END AS reason""", """
    WHERE trim(store_id) = '' OR trim(product_id) = '' OR current_stock < 0"""),
    "repeated_skus": _sql("""
    SELECT store_id, product_id, count(*) AS copies FROM updates GROUP BY ALL HAVING count(*) > 1""",
        "updates"),
    "risk_counts": _sql(f"SELECT stock_out_risk, {DECIDED_COUNTS}", "decided"),
    "action_counts": _sql(f"SELECT action, {DECIDED_COUNTS}", "decided"),
    "store_counts": _sql(f"SELECT store_id, {DECIDED_COUNTS}", "decided"),
    "reorder_totals": _all("decided", f"""{exact('recommended_reorder_quantity')} AS total_reorder_units,
           {r2(mean('predicted_daily_demand'))} AS avg_daily_demand"""),
    "top_reorder_stores": _all(
        "decided", f"store_id, {exact('recommended_reorder_quantity')} AS total_reorder",
        "GROUP BY store_id ORDER BY total_reorder DESC, store_id LIMIT 5",
    ),
    "top_demand_products": _all(
        "decided", f"product_id, {exact('predicted_daily_demand')} AS total_demand",
        "GROUP BY product_id ORDER BY total_demand DESC, product_id LIMIT 10",
    ),
    "row_counts": _all("decided", """count(*) AS rows, count(*) FILTER (action = 'REORDER') AS reorder,
           count(*) FILTER (action = 'MONITOR') AS monitor,
           count(*) FILTER (action = 'NO_ACTION') AS no_action"""),
    "action_subsets": _all("decided", rest="WHERE action = 'MONITOR'"),
    "high_risk_decisions": _all("decided", rest="WHERE stock_out_risk = 'HIGH'"),
    "home_kpis": _all("health_li", f"""CAST(sum(current_stock) AS BIGINT) AS total_inventory_units,
           {AT_RISK} AS at_risk_products, {r2(exact('actual_sales') + ' * 42')} AS today_sales_revenue,
           {_percent(AT_RISK, 'count(*)')} AS stockout_risk_percent"""),
    "risk_distribution": _all("health_li", ", ".join(
        f"count(*) FILTER (risk_level = '{t}') AS {t}" for t in ("LOW", "MEDIUM", "HIGH", "CRITICAL")
    )),
    "inventory_health": _all(
        "health", "store_id, product_id, current_stock, predicted_daily_demand, days_of_cover, risk_level"
    ),
    "top_at_risk": _all("health_li", "store_id, product_id, days_of_cover, risk_level", """
    WHERE risk_level IN ('HIGH', 'CRITICAL') ORDER BY days_of_cover, store_id, product_id LIMIT 5"""),
    "health_filtered": _all("health_li", rest="""
    WHERE contains(lower(store_id), 'store_01') AND contains(lower(product_id), '9')
      AND risk_level = 'MEDIUM'"""),
    "reorder_rows": _all("reorders"),
    "reorders_bucketed": _all("reorders"),
    "reorder_queue_filtered": _all("reorders", "*, store_id || '-' || product_id AS key", """
    WHERE contains(lower(store_id), 'store_0') AND contains(lower(product_id), 'prod_1')"""),
    "demand_predictions_first": _all("health_li", """TIMESTAMP '2024-01-31 12:00:00' AS timestamp,
           store_id, product_id, predicted_daily_demand, actual_sales""",
        "ORDER BY store_id, product_id LIMIT 200"),
    "prediction_rows": _all("predictions"),
    "demand_search": _all("predictions", rest="""
    WHERE contains(lower(store_id || ' ' || product_id || ' ' || date), '7 prod_0')"""),
    "demand_page": _all("predictions", rest="ORDER BY store_id, product_id LIMIT 20 OFFSET 60"),
    "demand_page_stored": _all("predictions", rest="""ORDER BY store_id, product_id LIMIT 20
    OFFSET (SELECT 20 * (CAST(ceil(count(*) / 20) AS BIGINT) // 2) FROM predictions)"""),
    "demand_page_after": _all("predictions", rest="""
    WHERE store_id > 'STORE_003' OR (store_id = 'STORE_003' AND product_id > 'PROD_100')
    ORDER BY store_id, product_id LIMIT 20"""),
    "demand_page_count": _all(
        "predictions", "count(*) AS rows, CAST(ceil(count(*) / 20) AS BIGINT) AS pages"
    ),
    "trend_scaffold": _sql(_scaffold("health_li", 14), "health_li"),
    "trend_kpis": _sql(f"""
    SELECT {exact("CASE WHEN series = 'sales_rate' THEN value END")} / 7 AS avg_daily_sales,
           {exact("CASE WHEN series = 'demand_rate' THEN value END")} / 7 AS avg_daily_demand,
           {exact("CASE WHEN series = 'reorder_rate' THEN value END")} AS reorder_events_count,
           (SELECT count(*) FROM health WHERE risk_level = 'CRITICAL') AS critical_sku_count
    FROM ({_scaffold('health', 7)})""", "health"),
    "daily_trend": _sql(_daily_trend("daily_li", "inventory_li"), "daily_li", "inventory_li"),
    "daily_trend_rollup": _sql(_daily_trend("daily", "inventory"), "daily", "inventory"),
    "daily_trend_last_days": _sql(f"""
    SELECT * FROM ({_daily_trend('daily', 'inventory')})
    WHERE CAST(date AS DATE) > (SELECT max(day) FROM daily) - 7""", "daily", "inventory"),
    "daily_predicted_vs_actual": _all("daily_predictions", f"""date,
           CAST(floor({mean('predicted_demand')} + 0.5) AS BIGINT) AS predicted,
           CAST(floor({mean('actual_demand')} + 0.5) AS BIGINT) AS actual""", "GROUP BY date"),
    "top_movers": _all("daily_predictions", f"""store_id, product_id,
           {mean('coalesce(actual_demand, predicted_demand)')} AS avg_daily_sales""", """
    GROUP BY ALL ORDER BY avg_daily_sales DESC, store_id, product_id LIMIT 10"""),
    "mover_trend": _sql(f"""
    SELECT *, CASE WHEN avg_daily_sales - previous_daily_sales > previous_daily_sales * 0.05::DOUBLE THEN 'up'
                   WHEN avg_daily_sales - previous_daily_sales < -(previous_daily_sales * 0.05::DOUBLE) THEN 'down'
                   ELSE 'stable' END AS trend
    FROM (SELECT store_id, product_id,
                 {r2("coalesce(sum(units) FILTER (day > DATE '2024-01-21'), 0) / 7")} AS avg_daily_sales,
                 {r2("coalesce(sum(units) FILTER (day <= DATE '2024-01-21'), 0) / 7")} AS previous_daily_sales
          FROM daily WHERE day > DATE '2024-01-14' AND day <= DATE '2024-01-28' GROUP BY ALL)""", "daily"),
    "train_test_split": _all("win_6h", f"window_start, store_id, product_id, {IS_TEST} AS is_test"),
    "null_features_dropped": _all("gaps", rest="WHERE total_units_sold IS NOT NULL AND total_revenue IS NOT NULL"),
    "null_features_not_scored": _all("gaps", rest="WHERE total_units_sold IS NOT NULL AND total_revenue IS NOT NULL"),
    "checked_windows": _all("win_6h", "*, 'missing columns: store_id, total_revenue; no rows' AS refusals"),
    "demand_rows_now": _all("health", "store_id, product_id, predicted_daily_demand, true AS stamped_now"),
    "version_stamps": _all("win_6h", "strftime(window_start, 'model_%Y%m%d_%H%M%S') AS version, count(*) AS windows",
        "GROUP BY version"),
    "metric_aggregates": _sql("""
    SELECT store_id, rows, floor(sqrt(squared) * 1000000 + 0.5) / 1000000 AS rmse,
           floor((1 - squared / variance) * 1000000 + 0.5) / 1000000 AS r2,
           floor(mae * 1000000 + 0.5) / 1000000 AS mae
    FROM (SELECT store_id, count(*) AS rows, avg(error * error) AS squared,
                 var_pop(CAST(next_units AS DOUBLE)) AS variance, avg(abs(error)) AS mae
          FROM (SELECT *, next_units - (total_units_sold * 0.5::DOUBLE + 1) AS error FROM next_6h)
          GROUP BY store_id)""", "next_6h"),
    "partitioned_scan": _all("win_1h", rest="""
    WHERE store_id = 'STORE_003' AND window_start >= TIMESTAMP '2024-01-05'
      AND window_start < TIMESTAMP '2024-01-20'"""),
    "partitioned_scan_offsets": _all("win_1h", rest="""
    WHERE window_start >= TIMESTAMP '2024-01-04 18:30:00'
      AND window_start < TIMESTAMP '2024-01-20 01:00:00'"""),
    "sku_directory_lookup": _sql(f"""
    SELECT * FROM ({windows('valid', 86400, 86400)})
    WHERE store_id = 'STORE_003' AND product_id = 'PROD_015'""", "valid"),
    "compacted_scan": _all("win_1h", rest="""
    WHERE window_end <= (SELECT max(event_time) FROM valid) - INTERVAL 10 MINUTE"""),
    "windowed_sql": _all("win_6h", "store_id, product_id, window_start, total_revenue", """
    WHERE store_id = 'STORE_001' ORDER BY window_start DESC, product_id LIMIT 10"""),
    "csv_inventory": _all("inventory_li"),
    "inventory_version": _all("upserted", UPDATED_COLUMNS),
    "stock_change_feed": _sql("""
    SELECT store_id, product_id,
           CASE WHEN gone THEN 'delisted' WHEN old_current_stock IS NULL THEN 'new' ELSE 'changed' END AS change,
           old_current_stock, CASE WHEN NOT gone THEN current_stock END AS current_stock,
           old_lead_time_days, CASE WHEN NOT gone THEN lead_time_days END AS lead_time_days
    FROM (SELECT u.*, i.current_stock AS old_current_stock, i.lead_time_days AS old_lead_time_days,
                 coalesce(i.current_stock % 9 = 0, false) AS gone
          FROM upserted u LEFT JOIN inventory_li i USING (store_id, product_id))
    WHERE gone OR old_current_stock IS NULL OR old_current_stock <> current_stock""",
        "upserted", "inventory_li"),
    "csv_sellers": _all("sellers_li", """store_id, product_id, seller_name, seller_contact,
           lower(trim(auto_confirm_eligible)) = 'true' AS auto_confirm_eligible"""),
    "reorder_export": _all("decided", rest="WHERE action = 'REORDER'"),
    "stream_windows_append": _all("closed_6h"),
    "stream_windows_panes": _all("closed_6h"),
    "stream_windows_update": _all("win_6h"),
    "stream_late_data": _all("closed_late"),
    "stream_restart": _all("closed_6h"),
    "stream_open_windows": _all("win_6h", "window_start, window_end, store_id, product_id", """
    WHERE window_end > (SELECT max(event_time) FROM valid) - INTERVAL 10 MINUTE"""),
    "stream_decisions_stock": _all("decided_more"),
    "stream_validated": _all("parsed_valid"),
    "stream_decisions": _all("decided_closed"),
}
