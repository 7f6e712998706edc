"""sparkweave: evidence-graph analytics and corpus preparation on Spark."""
