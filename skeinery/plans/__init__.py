"""Whole queries: the search engine and the registered queries."""
