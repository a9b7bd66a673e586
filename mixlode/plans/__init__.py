"""The mixture model and the query catalogue."""
