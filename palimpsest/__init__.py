"""palimpsest: revision analytics over corpora of structured documents, on PySpark."""

__version__ = "0.1.0"
