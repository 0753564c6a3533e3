"""Readers and writers: crawl tables, sitemap documents, fetched pages, JSON."""
