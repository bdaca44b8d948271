"""Point-cloud analytics on Spark."""
