"""Join choice and the whole imaging cycle."""
