"""strandweave: evidence analytics over documents, registries and graphs, written as Spark DataFrame plans."""

__version__ = "0.1.0"
