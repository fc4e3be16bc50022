"""Log analytics on Spark."""
