"""Streaming of the package."""
