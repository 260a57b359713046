"""Scans, reconstruction, reports and statistics: DataFrame in, DataFrame out."""
