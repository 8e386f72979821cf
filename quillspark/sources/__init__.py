"""Sources and sinks of record tables."""
