"""Spark-native scoring analytics: every operator is a DataFrame to DataFrame function."""
