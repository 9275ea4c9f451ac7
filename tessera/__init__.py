"""Topic-discovery and refusal analytics on Spark."""
