"""Operators for preparing language-model training data at scale.

Nothing else in the library imports this subpackage; its queries and oracles are
listed in :mod:`scorelake.llm.queries`.
"""
