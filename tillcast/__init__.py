"""tillcast: retail demand analytics written as Spark DataFrame jobs."""
