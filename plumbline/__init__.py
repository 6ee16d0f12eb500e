"""plumbline: a Spark-native data-quality assessment engine."""
