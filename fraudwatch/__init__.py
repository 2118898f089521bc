"""fraudwatch: scam-message analytics on PySpark DataFrames."""
