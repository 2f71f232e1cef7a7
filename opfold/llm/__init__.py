"""Training-data operators: WARC capture indexes, near-duplicate detection,
decontamination, token counts, nearest neighbours, text classifiers, chat
formatting and source mixing.

Nothing outside this subpackage imports it; ``queries.py`` holds the queries
that ``__spark_entry__.py`` registers when the subpackage is present.
"""
