"""Page-status streams."""
