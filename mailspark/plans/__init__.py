"""Plans of the message pipeline."""
