"""Annotation analytics and training-data operators on Spark."""
