"""ferrule: code-and-text analytics as Spark jobs."""
