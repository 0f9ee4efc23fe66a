"""Spark-native analytics over protein-domain annotation tables."""
