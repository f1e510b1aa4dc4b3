"""textbench: a Spark-native engine for benchmarking text classifiers."""

__version__ = "0.1.0"
