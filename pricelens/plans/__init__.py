"""Query registry (Spark plans) and the equivalent DuckDB oracle SQL."""
