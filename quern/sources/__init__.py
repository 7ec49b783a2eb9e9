"""Readers: note collections, alias resources, delimited files."""
