"""Operators of a training-data pipeline: text, web pages, vectors and archives as Spark jobs."""
