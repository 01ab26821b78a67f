"""Media-timeline planning and corpus preparation as Spark DataFrame jobs."""
