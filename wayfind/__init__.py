"""Spark-native search, recommendation and behaviour analytics."""
