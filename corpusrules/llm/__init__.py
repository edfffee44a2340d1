"""Operators of a training-data pipeline, each as functions from DataFrame to DataFrame."""
