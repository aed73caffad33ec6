"""Spark-native analytics over ordered panels, their text, timelines, edits and logs."""
