"""Fleet-metrics analytics as Spark jobs."""
