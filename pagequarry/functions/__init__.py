"""Column functions over URLs and page text."""
