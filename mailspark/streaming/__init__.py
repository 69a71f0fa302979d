"""Streaming of the message pipeline."""
