"""Batch analytics for chat logs, documents, cell grids and web pages, as Spark DataFrames."""
