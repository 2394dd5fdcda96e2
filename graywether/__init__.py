"""Decision and evaluation analytics over text states, written as Spark DataFrame jobs."""
