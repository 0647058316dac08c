"""Query plans: named queries and their DuckDB counterparts."""
