"""Relational operators: every one takes DataFrames and gives a lazy DataFrame."""
