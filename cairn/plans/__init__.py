"""Read views over result tables, and the registry of runnable queries."""
