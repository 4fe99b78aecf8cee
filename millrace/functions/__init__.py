"""Column expressions and record reshaping."""
