"""Streaming of the page-library engine."""
