"""Market-signal analytics as Spark DataFrame jobs."""
