"""Fixture views as portable SQL (FIXTURES.md), used by the DuckDB oracle.

``with_fixtures(sql)`` prepends, as CTEs, exactly the views a query refers
to (and the views those depend on), so every oracle string runs on the bare
driver tables.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {
    "f_menu_items": """
SELECT p_partkey AS item_id, p_name AS name,
       CASE p_type WHEN 'SMALL' THEN NULL ELSE p_brand END AS description,
       CAST(p_retailprice AS DECIMAL(10,2)) AS price,
       CASE p_type WHEN 'ECONOMY' THEN 'Pizza' WHEN 'STANDARD' THEN 'Salad' WHEN 'PROMO' THEN 'Burger'
                   WHEN 'SMALL' THEN 'Drink' WHEN 'LARGE' THEN 'Wrap' ELSE NULL END AS category,
       DATE '1995-01-01' AS date_added
FROM part""",
    "f_roster": """
SELECT CAST(s_suppkey AS INT) AS rider_id, s_name AS name FROM supplier""",
    "f_pending": """
SELECT o_orderkey AS order_id, o_custkey AS user_id, o_orderstatus AS outcome,
       CASE WHEN o_orderkey % 10 = 0 THEN TIMESTAMP '1998-06-15 00:00:00' ELSE o_orderdate END
         + ((o_orderkey * 7919) % 86400) * INTERVAL '1' SECOND AS ts
FROM orders""",
    "f_orders": """
SELECT o_orderkey AS order_id, o_custkey AS user_id, CAST(o_totalprice AS DECIMAL(10,2)) AS total_amount,
       'pending' AS status, n_name AS delivery_city
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "f_order_details": """
SELECT l_orderkey AS order_id, l_partkey AS item_id, CAST(l_quantity AS INT) AS quantity,
       CAST(l_extendedprice AS DECIMAL(10,2)) AS subtotal
FROM lineitem""",
    "f_orders_status": """
SELECT order_id, 'pending' AS status, CAST(NULL AS INT) AS rider_id, ts AS event_timestamp FROM f_pending
UNION ALL
SELECT order_id, 'accepted', CAST(order_id % (SELECT greatest(1, count(*)) FROM supplier) AS INT), ts + (1 + order_id % 11) * INTERVAL '1' MINUTE
FROM f_pending WHERE outcome = 'F'
UNION ALL
SELECT order_id, 'completed', CAST(order_id % (SELECT greatest(1, count(*)) FROM supplier) AS INT),
       ts + (2 * (1 + order_id % 11) + order_id % 17) * INTERVAL '1' MINUTE
FROM f_pending WHERE outcome = 'F' AND order_id % 7 <> 0
UNION ALL
SELECT order_id, 'denied', CAST((order_id + nth) % (SELECT greatest(1, count(*)) FROM supplier) AS INT), ts + (nth + order_id % 9) * INTERVAL '1' MINUTE
FROM f_pending CROSS JOIN (VALUES (1), (2), (3)) later(nth)
WHERE outcome = 'P' OR (outcome = 'O' AND nth <= order_id % 3)""",
    "f_users": """
SELECT c_custkey AS user_id, concat(c_name, '@example.com') AS email,
       concat('+39', lpad(CAST(c_custkey AS VARCHAR(10)), 10, '0')) AS phone_number,
       n_name AS city, CAST(min(ts) AS DATE) AS registration_date
FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN f_pending ON user_id = c_custkey
GROUP BY c_custkey, c_name, n_name""",
    "f_users_existing": """
SELECT * FROM f_users WHERE user_id % 2 = 0""",
    "f_requests": """
SELECT order_id, CASE WHEN order_id % 77 = 0 THEN '' ELSE email END AS email, phone_number, city, ts AS order_created_timestamp
FROM f_pending JOIN f_users ON f_pending.user_id = f_users.user_id""",
    "f_request_lines": """
SELECT order_id, item_id, CASE WHEN order_id % 91 = 0 AND item_id % 2 = 0 THEN NULL ELSE quantity END AS quantity
FROM (SELECT order_id, item_id, CAST(sum(q) AS INT) AS quantity
      FROM (SELECT l_orderkey AS order_id,
                   CASE WHEN l_orderkey % 50 = 0 AND l_linenumber = 1 THEN l_partkey + 1000000000 ELSE l_partkey END AS item_id,
                   CAST(l_quantity AS INT) AS q
            FROM lineitem) x
      GROUP BY order_id, item_id) y""",
    "f_responses": """
SELECT event_id AS response_id, event_id % (SELECT greatest(1, count(*) // 8) FROM orders) AS order_id,
       CAST(user_id % (SELECT greatest(1, count(*)) FROM supplier) AS INT) AS rider_id,
       CASE event_type WHEN 'click' THEN 'accepted' ELSE 'denied' END AS status, ts AS event_timestamp
FROM events""",
    "f_decisions": """
SELECT event_id AS response_id, event_id % (SELECT greatest(1, count(*) // 8) FROM orders) AS order_id,
       CAST(user_id % (SELECT greatest(1, count(*)) FROM supplier) AS INT) AS rider_id,
       CASE event_type WHEN 'click' THEN 'Yes' WHEN 'error' THEN 'NO' WHEN 'view' THEN 'maybe' WHEN 'signup' THEN 'yes' ELSE 'no' END AS decision,
       ts AS event_timestamp
FROM events""",
    "f_positions": """
SELECT event_id, lpad(CAST(user_id % 5 AS VARCHAR(5)), 5, '0') AS busline, ts AS position_ts,
       51.5 + value / 10000 AS latitude, -0.1 - value / 10000 AS longitude
FROM events""",
    "f_legacy_orders": """
SELECT CAST(o_orderkey AS VARCHAR(20)) AS id, c_name AS username, concat(c_name, '@example.com') AS email,
       o_orderpriority AS food, o_orderstatus AS size, CAST(floor(o_totalprice) AS INT) AS cost,
       o_orderdate + ((o_orderkey * 7919) % 86400) * INTERVAL '1' SECOND AS time,
       CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS order_completed
FROM orders JOIN customer ON o_custkey = c_custkey""",
}

_REF = re.compile(r"\bf_[a-z_]+\b")


def _deps(name: str) -> set[str]:
    return {m for m in _REF.findall(VIEWS[name]) if m in VIEWS and m != name}


def _ordered(names: set[str]) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        if n in out:
            return
        for d in sorted(_deps(n)):
            visit(d)
        out.append(n)

    for n in sorted(names):
        visit(n)
    return out


def with_fixtures(sql: str) -> str:
    """Prefix ``sql`` with the CTEs of the fixture views it references."""
    used = {m for m in _REF.findall(sql) if m in VIEWS}
    if not used:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in _ordered(used))
    body = sql.strip()
    if re.match(r"(?is)^with\s", body):
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"
