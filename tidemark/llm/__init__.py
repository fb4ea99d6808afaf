"""Operators of a training-data pipeline, each over whole tables and whole texts.

The registered queries are thin: ``queries.py`` derives the columns they return from the operators of this package.
"""
