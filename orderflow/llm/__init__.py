"""Training-data operators: encoding, cleaning, near duplicates, mixing.

Nothing else in the library imports this subpackage; ``__spark_entry__``
registers its queries when it is present.  Operators are plain functions
over DataFrames; ``queries`` holds the registered queries and their SQL.
"""
