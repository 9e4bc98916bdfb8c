"""Price-intelligence analytics on Spark."""
