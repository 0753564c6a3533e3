"""Page analytics on Spark: crawl tables, page parsing, reports and data preparation."""

__version__ = "0.1.0"
