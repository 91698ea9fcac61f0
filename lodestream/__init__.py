"""lodestream: retrieval analytics and corpus preparation as Spark DataFrame programs."""

__version__ = "0.1.0"
