"""Graph-fact analytics on Spark."""
