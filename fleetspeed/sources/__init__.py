"""Readers: raw files to typed DataFrames."""
