"""plumbline: evaluation, evidence and corpus analytics on PySpark DataFrames."""
