"""Operators for preparing language-model training data at scale.

Nothing else in the library imports this subpackage.  Each module holds one operator with a general
interface; :mod:`netlytics.llm.queries` applies the operators to the test tables.
"""
