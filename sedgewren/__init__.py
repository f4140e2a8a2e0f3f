"""sedgewren: a Spark-first engine for searchable page libraries and text corpora."""

__version__ = "0.1.0"
