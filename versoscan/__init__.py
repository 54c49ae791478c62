"""Document linting, judge evaluation and corpus preparation as Spark jobs."""
