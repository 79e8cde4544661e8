"""lanternq: a Spark-native engine for retrieval-grounded question answering over document collections."""

__version__ = "0.2.0"
