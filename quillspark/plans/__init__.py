"""Plans of record analyses."""
