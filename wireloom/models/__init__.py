"""Detectors and classifiers trained and scored on Spark."""
