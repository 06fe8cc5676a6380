"""Spark-native analytics over agent-session logs."""
