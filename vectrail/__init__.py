"""Vectrail: detection streams and embedding vectors as Spark DataFrames."""
