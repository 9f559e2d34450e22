"""Relational and ordered operators on DataFrames."""
