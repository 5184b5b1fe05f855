"""quern: a PySpark-native retrieval, context-graph and corpus analytics engine."""

__version__ = "0.1.0"
