"""A PySpark-native analytics engine: DuckDB-flavoured SQL and DataFrame operators over Parquet tables."""
