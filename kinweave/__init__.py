"""Record linkage on Spark."""
