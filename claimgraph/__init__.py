"""claimgraph: evidence-grounded facts on Spark."""
