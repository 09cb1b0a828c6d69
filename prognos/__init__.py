"""Fleet-telemetry analytics as Spark jobs."""
