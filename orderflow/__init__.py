"""orderflow: Spark-native order-flow analytics.

Every operator is a lazy ``DataFrame(s) -> DataFrame`` function built from
built-in Spark SQL expressions, so Catalyst can push filters into the scans,
prune columns and pick join strategies, and AQE can re-plan at runtime.
"""

from orderflow.session import get_session, checkpoint_root, scratch_path

__all__ = ["get_session", "checkpoint_root", "scratch_path"]
