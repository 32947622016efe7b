"""Lectern: table rows and files as searchable documents, on Spark DataFrames."""
