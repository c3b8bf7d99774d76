"""Readers and writers: CSV, relational tables, the article and vector stores, JSON."""
