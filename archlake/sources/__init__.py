"""Reading archives and keeping logs and overlays as Parquet tables."""
