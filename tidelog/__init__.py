"""Versioned key-value analytics on PySpark: a database is a DataFrame of versions (key, seq, ord, kind, value)."""
