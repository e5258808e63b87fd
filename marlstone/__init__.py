"""marlstone: relational, list, JSON, vector and full-text analytics on PySpark."""

__version__ = "0.1.0"
