"""Sources of the page-library engine."""
