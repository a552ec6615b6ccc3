"""Writers: Parquet, ordered CSV, gated and incremental writes."""
