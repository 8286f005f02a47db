"""Post-training data work as Spark DataFrame operators."""
