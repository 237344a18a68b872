"""Corpus operators for training-data pipelines (see README, "Corpus operators").

Nothing else in the library imports this package.  Each module holds one
operator; ``queries`` registers them for ``__spark_entry__.py``.
"""
