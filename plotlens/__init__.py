"""Land-market analytics as PySpark DataFrame jobs."""
