"""Sources and sinks: files, rows, remote services, databases."""
