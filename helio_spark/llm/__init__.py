"""Training-data operators over text tables: mixing, dedup, filters, counts, archives.

Nothing else in the library imports this subpackage. Every operator takes and
returns DataFrames; ``queries`` registers one query per operator.
"""
