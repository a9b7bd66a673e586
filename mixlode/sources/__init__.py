"""Feature assembly, readers and writers."""
