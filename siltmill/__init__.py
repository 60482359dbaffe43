"""siltmill: corpus deduplication and curation on Spark DataFrames."""

__version__ = "0.1.0"
