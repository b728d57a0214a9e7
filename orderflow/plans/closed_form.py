"""Oracles computed in closed form from the driver tables, without the order-flow views.

The fixture places every event of an order at a known second (FIXTURES.md), so
counts, amounts and delays follow from the order's key and outcome by
arithmetic.  These oracles never build the event log the operators read;
agreement checks the operators and the fixture mapping together.

Seconds are counted from 1998-06-15 00:00, so an event lies in the reporting
day if its second is in 0..86399, and its day is ``floor(second / 86400)``.
"""

from __future__ import annotations

#: One row per order: seconds of its pending, accepted and completed events
#: (NULL: none), the number of denials; denial i falls at ``den0 + 60 * i``.
CLOCK = """
clock AS (
  SELECT k, cust, outcome, amount, roster, pend,
         CASE WHEN outcome = 'F' THEN pend + 60 * (1 + k % 11) END AS acc,
         CASE WHEN outcome = 'F' AND k % 7 <> 0 THEN pend + 60 * (2 + 2 * (k % 11) + k % 17) END AS done,
         pend + 60 * (k % 9) AS den0,
         CASE outcome WHEN 'P' THEN 3 WHEN 'O' THEN k % 3 ELSE 0 END AS n_den
  FROM (SELECT o_orderkey AS k, o_custkey AS cust, o_orderstatus AS outcome,
               CAST(o_totalprice AS DECIMAL(10,2)) AS amount,
               (SELECT greatest(1, count(*)) FROM supplier) AS roster,
               (o_orderkey * 7919) % 86400 + CASE WHEN o_orderkey % 10 = 0 THEN 0
                 ELSE 86400 * date_diff('day', DATE '1998-06-15', CAST(o_orderdate AS DATE)) END AS pend
        FROM orders) base)"""

#: One row per order: what of it falls into the reporting day. Denials in the
#: day are those i in 1..n_den with 0 <= den0 + 60 * i <= 86399.
TODAY = CLOCK + """,
today AS (
  SELECT k, cust, amount, least(d, roster) AS n_deniers, d AS n_denied,
         CAST(pend BETWEEN 0 AND 86399 AS INT) AS p,
         CAST(coalesce(acc BETWEEN 0 AND 86399, FALSE) AS INT) AS a,
         CAST(coalesce(done BETWEEN 0 AND 86399, FALSE) AS INT) AS c
  FROM (SELECT *, greatest(0, least(n_den, CAST(floor((86399 - den0) / 60) AS BIGINT))
                              - greatest(1, CAST(ceil(-den0 / 60) AS BIGINT)) + 1) AS d
        FROM clock) slots)"""

_OPEN_TODAY = "CAST(sum(CAST(p + c + n_denied > 0 AND a = 0 AND n_deniers < 3 AS INT)) AS BIGINT)"

DAILY_KPIS = f"""
WITH {TODAY},
newest AS (SELECT max(pend) AS s FROM clock),
firsts AS (SELECT cust FROM clock GROUP BY cust HAVING floor(min(pend) / 86400) = 0)
SELECT CAST(sum(p) AS BIGINT) AS total_orders, {_OPEN_TODAY} AS active_orders,
       CAST(sum(amount * p) AS DECIMAL(20,2)) AS revenue,
       (SELECT count(*) FROM firsts) AS new_customers,
       (SELECT TIMESTAMP '1998-06-15 00:00:00' + to_seconds(s) FROM newest) AS last_order_time,
       (SELECT lpad(CAST((s % 86400 + 86400) % 86400 // 3600 AS VARCHAR), 2, '0') || ':'
               || lpad(CAST((s % 3600 + 3600) % 3600 // 60 AS VARCHAR), 2, '0') FROM newest) AS last_order_label
FROM today
"""

ACTIVE_TODAY = f"WITH {TODAY} SELECT {_OPEN_TODAY} AS active_orders FROM today"

# Every order is pending; the finished ones have an acceptance, those of outcome P three denials.
ACTIVE_ALL = """
SELECT count(*) - count(*) FILTER (WHERE o_orderstatus = 'F')
       - CASE WHEN (SELECT count(*) FROM supplier) >= 3
              THEN count(*) FILTER (WHERE o_orderstatus = 'P') ELSE 0 END AS active_orders
FROM orders
"""

DAILY_STATUS = f"""
WITH {TODAY},
n AS (SELECT CAST(sum(p) AS BIGINT) AS total_orders, {_OPEN_TODAY} AS pending_orders,
             CAST(sum(a) AS BIGINT) AS accepted_orders,
             CAST(sum(n_denied // 3) AS BIGINT) AS denied_orders,
             CAST(sum(c) AS BIGINT) AS completed_orders FROM today)
SELECT *, coalesce(round_even(CAST(completed_orders AS DOUBLE) / nullif(total_orders, 0) * 100, 2), 0.0)
       AS success_rate
FROM n
"""

DENIED_ORDERS = f"WITH {TODAY} SELECT k AS order_id, CAST(3 AS BIGINT) AS n_denied FROM today WHERE n_denied = 3"


def mix(key: str, drink: bool, pending: bool, revenue: bool) -> str:
    """Lines summed per part with the order's number of rows in the day as weight, then named."""
    weight = "p" if pending else "p + a + c + n_denied"
    label = "p_name" if key == "name" else "kind"
    kinds = ("('SMALL', 'Drink')" if drink else
             "('ECONOMY', 'Pizza'), ('STANDARD', 'Salad'), ('PROMO', 'Burger'), ('LARGE', 'Wrap')")
    money = ", CAST(sum(r) AS DECIMAL(20,2)) AS total_revenue" if revenue else ""
    return f"""
WITH {TODAY},
per_part AS (
  SELECT l_partkey, sum(CAST(l_quantity AS INT) * ({weight})) AS q,
         sum(CAST(l_extendedprice AS DECIMAL(10,2)) * ({weight})) AS r
  FROM lineitem, today WHERE k = l_orderkey AND {weight} > 0
  GROUP BY l_partkey)
SELECT {label} AS {key}, CAST(sum(q) AS BIGINT) AS quantity{money}
FROM part JOIN (VALUES {kinds}) kinds(code, kind) ON code = p_type JOIN per_part ON l_partkey = p_partkey
GROUP BY {label}"""


def share(key: str, mix_sql: str) -> str:
    return f"""
SELECT {key}, quantity, round(CAST(quantity AS DOUBLE) / sum(quantity) OVER (), 6) AS share
FROM ({mix_sql}) parts
"""


#: One row per order: year * 100 + month of its pending event (which never leaves its day).
PLACED = """
placed AS (
  SELECT o_custkey, CAST(o_totalprice AS DECIMAL(10,2)) AS amount,
         CASE WHEN o_orderkey % 10 = 0 THEN 199806
              ELSE CAST(strftime(o_orderdate, '%Y%m') AS INTEGER) END AS ym
  FROM orders)"""

YEARLY_ORDERS = f"""
WITH {PLACED}
SELECT ym - 199800 AS month, count(*) AS num_orders FROM placed WHERE ym // 100 = 1998 GROUP BY ym
"""

YEARLY_REVENUE = f"""
WITH {PLACED}
SELECT ym - 199800 AS month, CAST(sum(amount) AS DECIMAL(20,2)) AS revenue
FROM placed WHERE ym // 100 = 1998 GROUP BY ym
"""

# Orders are counted per customer first, then customers are placed in their nation.
REGION_ORDERS = f"""
WITH {PLACED},
per_customer AS (SELECT o_custkey, ym, count(*) AS n FROM placed WHERE ym // 100 = 1998 GROUP BY o_custkey, ym)
SELECT ym - 199800 AS month, n_name AS delivery_city, CAST(sum(n) AS BIGINT) AS num_orders
FROM per_customer, customer, nation
WHERE c_custkey = o_custkey AND n_nationkey = c_nationkey
GROUP BY ym, n_name
"""

YEAR_BOUNDS = f"WITH {PLACED} SELECT CAST(min(ym) // 100 AS INTEGER) AS min_year, CAST(max(ym) // 100 AS INTEGER) AS max_year FROM placed"

YEAR_LIST = f"""
WITH {PLACED}
SELECT CAST(unnest(generate_series(min(ym) // 100, max(ym) // 100)) AS INTEGER) AS year FROM placed
"""

YEARLY_SUMMARY = f"""
WITH {PLACED},
months AS (SELECT ym - 199800 AS month, CAST(count(*) AS DOUBLE) AS n, CAST(sum(amount) AS DOUBLE) AS r
           FROM placed WHERE ym // 100 = 1998 GROUP BY ym)
SELECT month, round(n, 6) AS num_orders, round(r, 6) AS revenue,
       round(max(n) OVER () * 1.1, 6) AS orders_max, round(max(r) OVER () * 1.1, 6) AS revenues_max
FROM months
"""

#: One row per answer of a rider: who, what, and the second it came.
ANSWERS = CLOCK + """,
answers AS (
  SELECT k % roster AS rider, 'accepted' AS status, acc AS s FROM clock WHERE acc IS NOT NULL
  UNION ALL
  SELECT k % roster, 'completed', done FROM clock WHERE done IS NOT NULL
  UNION ALL
  SELECT (k + i) % roster, 'denied', den0 + 60 * i FROM clock, range(1, 4) t(i) WHERE i <= n_den)"""

# A zero for every rider and status is added to the day's answers.
RIDER_STATUS_MATRIX = f"""
WITH {ANSWERS}
SELECT s_name AS name, status, CAST(sum(n) AS BIGINT) AS count_orders
FROM (SELECT rider, status, 1 AS n FROM answers WHERE s BETWEEN 0 AND 86399
      UNION ALL
      SELECT s_suppkey, unnest(['accepted', 'denied', 'completed']), 0 FROM supplier) x
JOIN supplier ON s_suppkey = rider
GROUP BY s_name, status
"""


def _rider_days(rider: int) -> str:
    """Days -14..0 of the month: a zero row per day and status, and the rider's answers."""
    return f"""{ANSWERS},
per_day AS (
  SELECT DATE '1998-06-15' + CAST(d AS INTEGER) AS day, status, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT floor(s / 86400) AS d, status, 1 AS n FROM answers
        WHERE rider = {rider} AND status <> 'accepted' AND s BETWEEN -14 * 86400 AND 86399
        UNION ALL
        SELECT d, unnest(['completed', 'denied']), 0 FROM range(-14, 1) t(d)) x
  GROUP BY d, status)"""


def rider_daily(rider: int) -> str:
    return f"""
WITH {_rider_days(rider)}
SELECT c.day, c.n AS completed_order_count, x.n AS denied_order_count
FROM per_day c JOIN per_day x ON x.day = c.day AND x.status = 'denied'
WHERE c.status = 'completed'
"""


def rider_daily_long(rider: int) -> str:
    return f"WITH {_rider_days(rider)} SELECT day, status || '_order_count' AS variable, n AS value FROM per_day"


GATE_STATE = f"""
WITH {CLOCK}
SELECT k AS order_id, CAST(acc IS NOT NULL AS BIGINT) AS accepted_count,
       CAST(least(n_den, roster) AS BIGINT) AS denied_count,
       ['pending', 'not_pending'][1 + CAST(acc IS NOT NULL OR least(n_den, roster) = 3 AS INT)] AS state
FROM clock
"""
