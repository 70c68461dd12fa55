"""Sources and sinks: parquet tables, bound views, JSON messages, images."""
