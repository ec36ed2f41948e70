"""Column-expression builders; every function takes and returns Columns."""
