"""Operators that prepare text for training language models.

Nothing else in the library imports this subpackage; ``queries`` and
``oracle_sql`` are picked up by the driver's entry file when it can be imported.
"""
