"""Growth and revenue analytics as plain PySpark DataFrame jobs."""
