"""Street-network investment analytics as Spark jobs."""
