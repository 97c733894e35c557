"""Sources: Parquet tables, CSV with delimiter/encoding detection, line text, rows, optional files."""
