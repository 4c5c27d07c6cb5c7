"""Growth measurement analytics on Spark."""
