"""Operators over edge and state DataFrames."""
