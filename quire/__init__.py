"""Document structuring and catalogue analytics on Spark."""
