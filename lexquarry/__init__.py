"""lexquarry: full-text search and text-table analytics on Spark DataFrames."""

__version__ = "0.1.0"
