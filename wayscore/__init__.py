"""Spark-native evaluation of trajectories, tracks, detections and scores."""
