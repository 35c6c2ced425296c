"""Property-ownership analytics as Spark DataFrame jobs."""
