"""Detection analytics and corpus curation expressed as PySpark plans."""

__version__ = "0.1.0"
