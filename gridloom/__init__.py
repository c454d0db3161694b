"""Spark-native analytics over hourly sensor panels, plus text-corpus operators."""
