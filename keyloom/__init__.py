"""Perfect-hash analytics on Spark."""
