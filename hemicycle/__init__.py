"""Electoral and districting analytics as Spark DataFrame jobs."""
