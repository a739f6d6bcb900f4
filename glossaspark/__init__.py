"""Spark operators for text-localization data pipelines."""
