"""Analytics for labelled tabular data, written as Spark DataFrame jobs."""
