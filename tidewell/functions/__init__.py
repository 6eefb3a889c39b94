"""Column functions; all are built-in expressions, so they stay in generated code."""
