"""Streams: a book of subjects against a static change, arriving list versions, and windowed event counts."""
