"""Daily-market-table analytics as Spark DataFrame jobs."""
