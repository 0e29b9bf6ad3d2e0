"""Spark-first toolkit for building, splitting and analysing labelled text corpora."""
