"""A calibration analytics engine on Spark DataFrames."""
