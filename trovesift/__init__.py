"""trovesift: a Spark-native retrieval and text-processing analytics engine."""
