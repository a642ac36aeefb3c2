"""barquet: market-analytics jobs for PySpark, every series at once."""
