"""Streaming forms of the batch roll-ups."""
