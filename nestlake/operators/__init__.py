"""Operators on event tables: every one takes DataFrames and returns a lazy DataFrame or Column."""
