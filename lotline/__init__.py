"""Property-to-building linkage and map-feature analytics as Spark jobs."""
