"""Plans of the page-library engine."""
