"""Spark-native data operations around an analytics warehouse."""
