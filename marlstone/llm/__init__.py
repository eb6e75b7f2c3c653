"""Training-data operators: extraction, deduplication, decontamination, scoring and mixing of text corpora.

Nothing outside this package imports it; ``queries`` holds the registered queries and their SQL.
"""
