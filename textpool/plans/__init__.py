"""Query catalogue over the driver's tables, with the equivalent DuckDB SQL."""
