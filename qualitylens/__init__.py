"""Quality and process telemetry analytics on Spark DataFrames."""
