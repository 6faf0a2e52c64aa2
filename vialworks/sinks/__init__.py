"""Writing catalogue files."""
