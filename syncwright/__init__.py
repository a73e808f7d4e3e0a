"""Record reconciliation between two peers, as Spark DataFrame operations."""
