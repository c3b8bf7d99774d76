"""Article search and listing as Spark jobs: prepare, list, embed, search, audit."""

__version__ = "0.1.0"
