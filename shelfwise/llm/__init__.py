"""Operators of a training-data pipeline: filters, deduplication, decontamination, tokenisation.

Every module holds one operator with its own general interface; ``catalog`` registers one query for each.
"""
