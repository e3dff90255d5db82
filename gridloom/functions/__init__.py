"""Column-expression builders for the query functions."""
