"""Spark jobs for a short-video material library and for training-data corpora."""
