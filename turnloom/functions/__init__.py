"""Column functions. Everything here maps Columns to Columns."""
