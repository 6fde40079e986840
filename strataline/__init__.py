"""Strataline: log reports as Spark tables.

Text reports become a numbered line table; markers, sections, entries, keyword
indexes and queries over them are DataFrame operations.  See README.md.
"""

__version__ = "0.1.0"
