"""Jobs composed from operators, and the query catalogue."""
