"""Operators for preparing training data at scale.

Each module holds one operator with a general interface; ``queries`` binds
them to the driver's tables. Nothing outside this package imports it.
"""
