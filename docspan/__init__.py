"""docspan: documentation-corpus analytics as Spark DataFrame jobs."""
