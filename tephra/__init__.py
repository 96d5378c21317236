"""Spark operators for the metadata, pixels and scores of a camera archive."""
