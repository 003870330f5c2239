"""Undertext: Spark analytics over documents that may hide instructions from their readers."""
