"""Readers (text layouts -> typed DataFrames) and sinks."""
