"""Writers: bronze Parquet, idempotent catalog appends, serving snapshots, feedback."""
