"""Reserved for incremental variants; the record analyses are batch work."""
