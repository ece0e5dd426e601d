"""Streaming variants of the additive statistics."""
