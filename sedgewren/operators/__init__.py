"""Operators of the page-library engine."""
