"""tessera: a Spark-native engine for point-in-time time-series research."""

__version__ = "0.1.0"
