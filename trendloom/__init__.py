"""Content-trend analytics as DataFrame-to-DataFrame Spark jobs."""
