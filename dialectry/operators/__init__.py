"""Corpus operators as functions from DataFrame to DataFrame."""
