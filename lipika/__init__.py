"""lipika: corpus building, indexing and retrieval as Spark DataFrame plans."""

__version__ = "0.1.0"
