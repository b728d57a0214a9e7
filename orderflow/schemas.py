"""Explicit schemas for every table and message (no inference anywhere).

Batch tables keep zone-less ``timestamp_ntz``; stream entry points cast
to ``timestamp`` because watermarks reject NTZ columns.
"""

from __future__ import annotations

from pyspark.sql import types as T

N_RIDERS = 3  # quorum of distinct denials that fails an order

STATUSES = ("pending", "accepted", "denied", "completed")

USERS = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("email", T.StringType()),
    T.StructField("phone_number", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("registration_date", T.DateType()),
])

RIDERS = T.StructType([
    T.StructField("rider_id", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("phone_number", T.StringType()),
    T.StructField("vehicle_type", T.StringType()),
    T.StructField("vehicle_registration", T.StringType()),
])

ORDERS = T.StructType([
    T.StructField("order_id", T.LongType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("total_amount", T.DecimalType(10, 2)),
    T.StructField("status", T.StringType()),
    T.StructField("delivery_city", T.StringType()),
    T.StructField("delivery_instructions", T.StringType()),
    T.StructField("order_created_timestamp", T.TimestampNTZType()),
])

ORDERS_STATUS = T.StructType([
    T.StructField("order_id", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("rider_id", T.IntegerType()),
    T.StructField("event_timestamp", T.TimestampNTZType()),
])

MENU_ITEMS = T.StructType([
    T.StructField("item_id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("price", T.DecimalType(10, 2)),
    T.StructField("category", T.StringType()),
    T.StructField("date_added", T.DateType()),
])

ORDER_DETAILS = T.StructType([
    T.StructField("order_id", T.LongType()),
    T.StructField("item_id", T.LongType()),
    T.StructField("quantity", T.IntegerType()),
    T.StructField("subtotal", T.DecimalType(10, 2)),
])

LEGACY_ORDERS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("username", T.StringType()),
    T.StructField("email", T.StringType()),
    T.StructField("food", T.StringType()),
    T.StructField("size", T.StringType()),
    T.StructField("cost", T.IntegerType()),
    T.StructField("time", T.TimestampNTZType()),
    T.StructField("order_completed", T.IntegerType()),
])

# Confirmed-order message as sent on the confirmed topic.  ``user`` is the
# older spelling of ``username`` used by some producers.
CONFIRMED_MESSAGE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("username", T.StringType()),
    T.StructField("user", T.StringType()),
    T.StructField("email", T.StringType()),
    T.StructField("food", T.StringType()),
    T.StructField("size", T.StringType()),
    T.StructField("cost", T.IntegerType()),
    T.StructField("time", T.TimestampNTZType()),
    T.StructField("order_completed", T.IntegerType()),
])

COMPLETED_MESSAGE = T.StructType([
    T.StructField("order_id", T.LongType()),
    T.StructField("email_id", T.StringType()),
])

ORDER_MESSAGE = T.StructType([
    T.StructField("order_id", T.LongType()),
    T.StructField("email", T.StringType()),
    T.StructField("phone_number", T.StringType()),
    T.StructField("order_info", T.MapType(T.StringType(), T.IntegerType())),
    T.StructField("city", T.StringType()),
    T.StructField("order_created_timestamp", T.StringType()),
    T.StructField("delivery_instructions", T.StringType()),
])

RIDER_RESPONSE = T.StructType([
    T.StructField("response_id", T.LongType()),
    T.StructField("order_id", T.LongType()),
    T.StructField("rider_id", T.IntegerType()),
    T.StructField("status", T.StringType()),
    T.StructField("event_timestamp", T.TimestampNTZType()),
])

POSITION_MESSAGE = T.StructType([
    T.StructField("busline", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
])

GEOJSON = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("features", T.ArrayType(T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
        T.StructField("geometry", T.StructType([
            T.StructField("type", T.StringType()),
            T.StructField("coordinates", T.ArrayType(T.ArrayType(T.DoubleType()))),
        ])),
    ]))),
])

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])

# The seed rows of the reference's database (riders and menu),
# used by the hand-written unit cases.
SEED_RIDERS = [
    (1, "Fabio", "2345324532", "auto", None),
    (2, "Simone", "2253523532", "moto", None),
    (3, "Matteo", "2253523532", "auto", None),
    (4, "Alessandro", "2253523532", "moto", None),
]

SEED_MENU = [
    ("Margherita Pizza", "Classic tomato sauce, mozzarella, basil", "9.99", "Pizza"),
    ("Pepperoni Pizza", "Tomato sauce, mozzarella, pepperoni", "11.99", "Pizza"),
    ("Chicken Caesar Salad", "Grilled chicken, romaine lettuce, croutons, parmesan cheese, Caesar dressing", "8.99", "Salad"),
    ("Cheeseburger", "Beef patty, cheddar cheese, lettuce, tomato, onion, pickles, mayo, ketchup", "10.99", "Burger"),
    ("Vegetarian Wrap", "Grilled vegetables, hummus, lettuce, tomato, cucumber, feta cheese, tzatziki sauce", "7.99", "Wrap"),
    ("Roadhouse", "Double Beef patty, double cheddar cheese, lettuce, tomato, chimera sauce", "14.99", "Burger"),
    ("Wrong Margherita", "Tomato sauce, mozzarella, basil cream", "14.99", "Pizza"),
    ("Beef Wrap", "Beef, potatoes, mayo, bacon", "7.99", "Wrap"),
    ("Coca-Cola", None, "3.5", "Drink"),
    ("Water", None, "2", "Drink"),
]
