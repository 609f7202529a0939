"""The query language: parsing, planning onto DataFrames, sessions."""
