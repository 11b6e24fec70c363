"""Changes as streams."""
