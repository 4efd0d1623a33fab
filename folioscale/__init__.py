"""folioscale: document-intelligence and corpus operators as Spark DataFrame jobs."""
