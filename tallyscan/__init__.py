"""Document field extraction and reconciliation on Spark."""
