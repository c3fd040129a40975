"""Source-code graph analytics and run telemetry on PySpark DataFrames."""
