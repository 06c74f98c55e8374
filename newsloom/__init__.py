"""newsloom: curation of large news-like text collections on PySpark."""

__version__ = "0.1.0"
