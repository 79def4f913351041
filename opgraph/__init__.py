"""opgraph: a PySpark-native document -> property graph -> hybrid retrieval engine."""

__version__ = "0.1.0"
