"""Retrieval analytics over document tables as Spark DataFrame transformations."""
