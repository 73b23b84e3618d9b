"""Multi-level graph analytics on PySpark."""
