"""Operators for training-data pipelines.

Nothing else in the library imports this subpackage. Every operator keeps its own general interface;
the thin ``opN_<name>`` queries in :mod:`sessionlake.llm.queries` derive their columns from it.
"""
