"""Column -> Column helpers. Everything compiles to built-in expressions (no Python workers)."""
