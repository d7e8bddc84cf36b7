"""Evidence scoring and analytics over semi-structured site records, on Spark."""

__version__ = "0.1.0"
