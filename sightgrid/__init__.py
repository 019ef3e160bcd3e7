"""Multi-camera safety-event analytics on Spark DataFrames."""
