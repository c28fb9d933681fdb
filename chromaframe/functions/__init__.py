"""Column expressions: no query runs here."""
