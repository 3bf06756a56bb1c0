"""Operators for preparing training text at scale.

Nothing outside this folder, ``corpus_pipeline.py`` and ``__spark_entry__.py``
imports from here, so the rest of the library works without it.
"""
