"""Spark-native data processing for deal files: messy tables in, typed and linked tables out."""

__version__ = "0.1.0"
