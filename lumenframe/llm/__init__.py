"""Operators that prepare text corpora for model training.

Nothing outside this subpackage imports it.  Each module holds one operator with
its own general interface; ``queries`` wraps them into registered queries.
"""
