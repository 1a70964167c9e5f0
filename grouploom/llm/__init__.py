"""Operators for preparing large text corpora.

Nothing outside this folder imports it; ``queries()`` and ``oracle_sql()`` in
:mod:`grouploom.llm.registry` are added to the driver contract when the folder is present.
"""
