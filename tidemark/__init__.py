"""tidemark: a Spark-native engine for keyed record streams and the tables they feed."""

__version__ = "0.1.0"
