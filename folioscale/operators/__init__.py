"""Operators on pages, lines and documents. All are narrow: a document's lines stay in one row, as an array."""
