"""End-to-end plans and the queries over the given tables."""
