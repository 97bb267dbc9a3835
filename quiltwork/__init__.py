"""quiltwork: a PySpark-native engine for building compact, representative data mixtures."""

__version__ = "0.1.0"
