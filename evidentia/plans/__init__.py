"""Whole flows: claim checking, search, crawl and index; and the catalogue of registered queries."""
