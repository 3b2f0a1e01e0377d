"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.  Each module holds one
operator with its own general interface; :mod:`ranksmith.llm.queries` applies
them to the given tables.
"""
