"""Functions of record analyses."""
