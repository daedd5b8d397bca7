"""Document clustering and classification as Spark DataFrame jobs."""
