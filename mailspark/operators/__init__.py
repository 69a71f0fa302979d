"""Operators of the message pipeline."""
