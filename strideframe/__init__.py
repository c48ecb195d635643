"""strideframe: Spark-first analytics over time-stamped movement data."""
