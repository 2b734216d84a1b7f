"""Parity harness: Spark queries on the driver tables and their DuckDB oracle SQL."""
