"""Spatio-temporal event analytics on Spark: detections to tracks, visits, fates and counts."""
