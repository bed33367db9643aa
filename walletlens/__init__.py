"""Mobile-money transaction analytics, written as Spark DataFrame jobs."""
