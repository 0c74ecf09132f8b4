"""Operators for training-data pipelines: scans, filters, deduplication, scoring and tokenizing of texts.

Every operator takes DataFrames, reads only the columns it names and ignores all others, so further columns
may have any name. Nothing else in the library imports this folder.
"""
