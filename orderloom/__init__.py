"""Trade-flow analytics as Spark DataFrame jobs."""
