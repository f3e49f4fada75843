"""Operators for large training-data corpora.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds the
queries in ``gleaner.llm.queries`` when it is present.
"""
