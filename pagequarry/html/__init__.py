"""Parsing of HTML as it is found: tokens, trees, selectors, Markdown."""
