"""Reading landed files and tables, and writing tables with upsert semantics."""
