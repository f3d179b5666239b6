"""Sources and sinks: parquet tables, landed CSV/JSON files, derived fixtures."""
