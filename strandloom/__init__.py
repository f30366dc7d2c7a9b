"""Spark-native genome-variant analytics."""
