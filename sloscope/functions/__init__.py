"""Column expressions and plan-time parsers."""
