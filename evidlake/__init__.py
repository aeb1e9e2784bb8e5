"""Spark-native evidence and posture analytics over fleet-scale tables."""
