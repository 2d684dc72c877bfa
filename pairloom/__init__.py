"""pairloom: a PySpark engine for comparing pairs of short texts at scale."""

__version__ = "0.1.0"
