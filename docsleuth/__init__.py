"""Document-integrity analytics on Spark."""
