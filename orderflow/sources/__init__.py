from orderflow.sources.tables import read_table, read_jdbc_table, TABLES
from orderflow.sources.fixtures import Fixtures

__all__ = ["read_table", "read_jdbc_table", "TABLES", "Fixtures"]
