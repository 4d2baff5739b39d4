"""Vector-set and point-cloud analytics on PySpark DataFrames."""
