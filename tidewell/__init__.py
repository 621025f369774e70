"""Tidewell: set-oriented analytics for document, conversation and event data on PySpark."""
