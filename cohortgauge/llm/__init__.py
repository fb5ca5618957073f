"""Operators for large-scale training-data preparation.

Nothing outside this folder imports it. Each module holds one operator with its own
interface; ``queries`` registers the contract queries on top of them.
"""
