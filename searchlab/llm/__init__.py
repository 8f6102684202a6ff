"""Operators of a training-data pipeline: packing, dedup, decontamination, scoring, extraction.

Nothing else in the library imports this subpackage; ``queries`` registers its queries.
"""
