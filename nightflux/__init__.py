"""Light-curve analytics as Spark jobs."""
