"""Order-log queries: ingest (B) and dispatch / gate / state (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from orderflow.operators import ingest, lifecycle
from orderflow.plans import closed_form
from orderflow.plans.catalog import N, RIDER, fx, register

# -- ingest (B) ------------------------------------------------------------------

_INGEST = """
WITH lines AS (SELECT l.order_id, l.item_id, l.quantity, m.price,
                      CAST(m.price * l.quantity AS DECIMAL(10,2)) AS subtotal
               FROM f_request_lines l LEFT JOIN f_menu_items m ON l.item_id = m.item_id),
valid AS (SELECT q.* FROM f_requests q
          WHERE coalesce(q.email <> '', false) AND coalesce(q.phone_number <> '', false)
            AND coalesce(q.city <> '', false)
            AND q.order_id IN (SELECT order_id FROM f_request_lines)),
bad AS (SELECT order_id, bool_or(price IS NULL) AS unknown, bool_or(quantity IS NULL) AS nullq
        FROM lines WHERE order_id IN (SELECT order_id FROM valid)
        GROUP BY order_id HAVING bool_or(price IS NULL) OR bool_or(quantity IS NULL)),
ok AS (SELECT * FROM valid WHERE order_id NOT IN (SELECT order_id FROM bad)),
ok_lines AS (SELECT * FROM lines WHERE order_id IN (SELECT order_id FROM ok)),
tot AS (SELECT order_id, CAST(SUM(subtotal) AS DECIMAL(10,2)) AS total_amount FROM ok_lines GROUP BY order_id),
firsts AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY email ORDER BY order_created_timestamp, order_id) AS rn
                          FROM ok) x WHERE rn = 1),
users AS (SELECT user_id, email, phone_number, city, registration_date FROM f_users_existing
          UNION ALL
          SELECT (SELECT coalesce(max(user_id), -1) FROM f_users_existing) + 1 + order_id, email, phone_number, city,
                 CAST(order_created_timestamp AS DATE)
          FROM firsts WHERE email NOT IN (SELECT email FROM f_users_existing))
"""


def _split(spark, sf, materialize=False, price_once=False):
    """Requests as a table: header rows plus flat line rows (no per-order collect).

    ``materialize`` where the query itself reads the verdict more than once, ``price_once`` where it gives lines.
    """
    f = fx(spark, sf)
    return f, ingest.split_requests(f.requests, f.menu_items, lines=f.request_lines, materialize=materialize,
                                    price_once=price_once)


def _users(spark, sf):
    f, (ok, _lines, _rej) = _split(spark, sf)
    return ingest.upsert_users(f.users_existing, ok)


def _orders(spark, sf):
    f, (ok, lines, _rej) = _split(spark, sf, materialize=True)  # ok feeds the upsert and the join
    users = ingest.upsert_users(f.users_existing, ok)
    return ingest.ingest_orders(ok, users)


@register("ingest_rejected", oracle=_INGEST + """
SELECT order_id, 'invalid_request' AS reason FROM f_requests WHERE order_id NOT IN (SELECT order_id FROM valid)
UNION ALL
SELECT order_id, CASE WHEN unknown THEN 'unknown_item' ELSE 'null_quantity' END FROM bad
""", headline=True)
def q_ingest_rejected(spark, sf):
    return _split(spark, sf)[1][2]


@register("order_lines", oracle=_INGEST + "SELECT order_id, item_id, quantity, price, subtotal FROM ok_lines")
def q_order_lines(spark, sf):
    return ingest.order_lines(_split(spark, sf, price_once=True)[1][1])


@register("upsert_users", oracle=_INGEST + "SELECT * FROM users")
def q_upsert_users(spark, sf):
    return _users(spark, sf)


@register("ingest_orders", oracle=_INGEST + """
SELECT o.order_id, u.user_id, t.total_amount, 'pending' AS status, o.city AS delivery_city,
       CAST(NULL AS VARCHAR) AS delivery_instructions, o.order_created_timestamp
FROM ok o JOIN tot t ON o.order_id = t.order_id LEFT JOIN users u ON o.email = u.email
""", headline=True)
def q_ingest_orders(spark, sf):
    return _orders(spark, sf)


@register("initial_events", oracle=_INGEST + """
SELECT order_id, 'pending' AS status, CAST(NULL AS INTEGER) AS rider_id, order_created_timestamp AS event_timestamp
FROM ok WHERE order_id IN (SELECT order_id FROM tot)
""")
def q_initial_events(spark, sf):
    return ingest.initial_events(_split(spark, sf)[1][0])


@register("order_details", oracle=_INGEST + "SELECT order_id, item_id, quantity, subtotal FROM ok_lines")
def q_order_details(spark, sf):
    return ingest.order_details(_split(spark, sf, price_once=True)[1][1])


@register("append_completions", oracle="""
SELECT order_id, status, rider_id, event_timestamp FROM f_orders_status
UNION ALL
SELECT order_id, 'completed', rider_id, event_timestamp + INTERVAL 20 MINUTE FROM f_responses WHERE status = 'accepted'
""")
def q_append_completions(spark, sf):
    f = fx(spark, sf)
    done = (f.responses.filter(F.col("status") == "accepted")
            .select("order_id", "rider_id",
                    F.timestamp_add("MINUTE", F.lit(20), F.col("event_timestamp")).alias("event_timestamp")))
    return ingest.append_completions(f.orders_status, done)


@register("overlay_status", oracle="""
WITH u AS (SELECT order_id, 'Pending to accept' AS new_status, event_timestamp, response_id
           FROM f_responses WHERE status = 'accepted'),
l AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY order_id ORDER BY event_timestamp DESC, response_id DESC) AS rn
                     FROM u) x WHERE rn = 1)
SELECT o.order_id, coalesce(l.new_status, o.status) AS status, l.event_timestamp AS updated_at
FROM f_orders o LEFT JOIN l ON o.order_id = l.order_id
""")
def q_overlay_status(spark, sf):
    f = fx(spark, sf)
    upd = (f.responses.filter(F.col("status") == "accepted")
           .select("order_id", F.lit("Pending to accept").alias("status"), "event_timestamp", "response_id"))
    return ingest.overlay_status(f.orders, upd)


@register("accept_before_deny", oracle="""
SELECT order_id, first_accepted, last_denied FROM (
  SELECT order_id, MIN(CASE WHEN status = 'accepted' THEN event_timestamp END) AS first_accepted,
         MAX(CASE WHEN status = 'denied' THEN event_timestamp END) AS last_denied
  FROM f_responses GROUP BY order_id) x
WHERE first_accepted <= last_denied
""")
def q_accept_before_deny(spark, sf):
    return ingest.accept_before_deny(fx(spark, sf).responses)


@register("repeat_denials", oracle="""
SELECT order_id, rider_id, COUNT(*) AS n_denials FROM f_responses WHERE status = 'denied'
GROUP BY order_id, rider_id HAVING COUNT(*) > 1
""")
def q_repeat_denials(spark, sf):
    return ingest.repeat_denials(fx(spark, sf).responses)


# -- dispatch, gate, state (C) -----------------------------------------------------------

@register("offers", oracle="SELECT order_id, (SELECT COUNT(DISTINCT rider_id) FROM f_roster) AS n_offers FROM f_orders")
def q_offers(spark, sf):
    f = fx(spark, sf)
    return lifecycle.offers(f.orders, f.roster)


@register("responses_named", oracle="""
SELECT r.*, f.name AS rider_name FROM f_responses r LEFT JOIN f_roster f ON r.rider_id = f.rider_id
""")
def q_responses_named(spark, sf):
    f = fx(spark, sf)
    return lifecycle.with_rider_name(f.responses, f.roster)


@register("rider_ids", oracle="SELECT rider_id FROM f_roster")
def q_rider_ids(spark, sf):
    return lifecycle.active_riders(fx(spark, sf).roster)


@register("decisions", oracle="""
SELECT *, CASE lower(decision) WHEN 'yes' THEN 'accepted' WHEN 'no' THEN 'denied' ELSE 'invalid' END AS status
FROM f_decisions
""")
def q_decisions(spark, sf):
    return lifecycle.normalise_decisions(fx(spark, sf).decisions)


@register("gate_state", oracle=closed_form.GATE_STATE)
def q_gate_state(spark, sf):
    return lifecycle.gate_state(fx(spark, sf).orders_status, N)


GATE_SQL = """
WITH r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY order_id, rider_id, status
                                        ORDER BY event_timestamp, response_id) AS k
           FROM f_responses),
c AS (SELECT *,
        COALESCE(SUM(CASE WHEN status = 'accepted' THEN 1 ELSE 0 END) OVER w, 0) AS acc_before,
        COALESCE(SUM(CASE WHEN status = 'denied' AND k = 1 THEN 1 ELSE 0 END) OVER w, 0) AS den_before
      FROM r
      WINDOW w AS (PARTITION BY order_id ORDER BY event_timestamp, response_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT response_id, order_id, rider_id, status, event_timestamp FROM c
WHERE acc_before = 0 AND den_before < 3
"""


@register("gate_batch", oracle=GATE_SQL, headline=True)
def q_gate_batch(spark, sf):
    return lifecycle.admit_responses(fx(spark, sf).responses, N)


@register("gate_batch_log", oracle="""
WITH lg AS (SELECT DISTINCT order_id, rider_id, status FROM f_orders_status
            WHERE rider_id IS NOT NULL AND status IN ('accepted', 'denied')),
u AS (SELECT 0 AS src, CAST(NULL AS BIGINT) AS response_id, order_id, rider_id, status,
             CAST(NULL AS TIMESTAMP) AS event_timestamp FROM lg
      UNION ALL
      SELECT 1, response_id, order_id, rider_id, status, event_timestamp FROM f_responses),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY order_id, rider_id, status
                                   ORDER BY src, event_timestamp, response_id) AS k FROM u),
c AS (SELECT *,
        COALESCE(SUM(CASE WHEN status = 'accepted' THEN 1 ELSE 0 END) OVER w, 0) AS acc_before,
        COALESCE(SUM(CASE WHEN status = 'denied' AND k = 1 THEN 1 ELSE 0 END) OVER w, 0) AS den_before
      FROM r
      WINDOW w AS (PARTITION BY order_id ORDER BY src, event_timestamp, response_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT response_id, order_id, rider_id, status, event_timestamp FROM c
WHERE src = 1 AND acc_before = 0 AND den_before < 3
""")
def q_gate_batch_log(spark, sf):
    f = fx(spark, sf)
    return lifecycle.admit_responses(f.responses, N, log=f.orders_status)


@register("order_outcomes", oracle="""
SELECT order_id,
       CASE WHEN COUNT(CASE WHEN status = 'completed' THEN 1 END) > 0 THEN 'completed'
            WHEN COUNT(DISTINCT CASE WHEN status = 'accepted' THEN rider_id END) > 0 THEN 'accepted'
            WHEN COUNT(DISTINCT CASE WHEN status = 'denied' THEN rider_id END) >= 3 THEN 'failed'
            ELSE 'pending' END AS outcome
FROM f_orders_status GROUP BY order_id
""", headline=True)
def q_order_outcomes(spark, sf):
    return lifecycle.order_outcomes(fx(spark, sf).orders_status, N)


@register("rider_orders", oracle=f"""
WITH mine AS (
  SELECT order_id, rider_id, status, event_timestamp FROM f_orders_status
  WHERE rider_id = {RIDER} AND status IN ('accepted', 'completed')),
finished AS (SELECT DISTINCT order_id FROM f_orders_status WHERE status = 'completed'),
created AS (SELECT order_id, event_timestamp AS created_at FROM f_orders_status WHERE status = 'pending'),
first_accept AS (
  SELECT order_id, min(event_timestamp) AS accepted_at FROM f_orders_status
  WHERE status = 'accepted' GROUP BY order_id)
SELECT m.order_id, m.rider_id, m.status, c.created_at AS order_creation_timestamp,
       CASE m.status WHEN 'accepted' THEN m.event_timestamp ELSE fa.accepted_at END AS order_acceptance_timestamp,
       CASE m.status WHEN 'completed' THEN m.event_timestamp END AS order_completion_timestamp,
       o.total_amount
FROM mine m
JOIN created c ON c.order_id = m.order_id
LEFT JOIN first_accept fa ON fa.order_id = m.order_id
LEFT JOIN f_orders o ON o.order_id = m.order_id
WHERE m.status = 'completed' OR m.order_id NOT IN (SELECT order_id FROM finished)
""", headline=True)
def q_rider_orders(spark, sf):
    f = fx(spark, sf)
    return lifecycle.rider_orders(f.orders_status, f.orders, RIDER)


@register("match_responses", oracle="""
SELECT r.*, o.total_amount FROM f_responses r JOIN f_orders o ON r.order_id = o.order_id
WHERE r.rider_id IN (SELECT rider_id FROM f_roster)
""")
def q_match_responses(spark, sf):
    f = fx(spark, sf)
    return lifecycle.match_responses(f.responses, f.orders, f.roster)


@register("latest_order", oracle="SELECT MAX(order_id) AS latest_order_id FROM f_orders")
def q_latest_order(spark, sf):
    return lifecycle.latest_order_id(fx(spark, sf).orders)
