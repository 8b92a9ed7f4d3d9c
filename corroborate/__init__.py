"""Record linkage, data quality and corpus operators as Spark jobs."""
