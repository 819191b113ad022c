"""quern: a Spark-first analytics engine for document-shaped and tabular data."""

__version__ = "0.1.0"
