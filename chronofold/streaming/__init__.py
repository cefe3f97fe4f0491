"""Features of series that arrive as streams."""
