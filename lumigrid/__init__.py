"""Spark-native analytics for image stacks, movies and object lineages."""
