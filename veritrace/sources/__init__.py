"""Scans of published lists (delimited text, XML, workbooks), the adapters that conform them to the record model, and their registry."""
