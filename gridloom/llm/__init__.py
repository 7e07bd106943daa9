"""Training-data operators: deduplication, scoring, scanning, archiving and tokenising of text corpora.

Nothing else in the library imports this subpackage.
"""
