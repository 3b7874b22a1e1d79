"""Spark-native verification analytics: manifests, comparison pairs, error rates."""
