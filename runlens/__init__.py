"""runlens: Spark-native analytics over data jobs, their recordings and the data between their steps."""

__version__ = "0.1.0"
