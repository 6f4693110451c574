"""Market time-series analytics as PySpark DataFrame functions and streaming jobs."""
