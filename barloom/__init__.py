"""Bar analytics on Spark."""
