"""What is decided before Spark plans a query: relations, pruning, advice."""
