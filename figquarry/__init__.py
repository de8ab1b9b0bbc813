"""Spark-first operators for figure datasets and model-answer analytics."""
