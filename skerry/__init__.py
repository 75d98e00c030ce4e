"""skerry: a Spark-native screening, ranking and corpus-processing engine."""

__version__ = "0.1.0"
