"""Operators of a training-data pipeline: text filters, duplicates, tokens, packing, archives.

Nothing outside this package imports it.  ``catalog`` lists its queries and their SQL.
"""
