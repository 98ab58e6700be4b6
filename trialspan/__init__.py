"""Trial tables, event logs and round-indexed streams on Spark."""
