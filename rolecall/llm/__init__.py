"""Operators of a training-data pipeline over a table of documents.

One module per operator, ``rows`` and ``components`` for what they share, and
``queries`` with the registered queries. Nothing outside this package and
``corpus_pipeline.py`` imports it.
"""
