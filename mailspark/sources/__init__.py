"""Sources of the message pipeline."""
