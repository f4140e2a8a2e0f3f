"""Functions of the page-library engine."""
