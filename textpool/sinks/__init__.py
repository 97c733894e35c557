"""Sinks: CSV/Parquet tables, JSON reports, result/statistics exports, run-partitioned layout."""
