"""Sources and sinks of framed files."""
