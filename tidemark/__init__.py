"""Point-in-time analytics on PySpark."""
