"""DataFrame operators and jobs for indicator analytics on Spark."""
