"""Streams, and state that is folded in order."""
