"""Two-sided matching analytics as Spark DataFrame jobs."""
