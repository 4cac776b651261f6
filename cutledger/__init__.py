"""Shot-table analytics on Spark: DataFrames in, DataFrames out."""
