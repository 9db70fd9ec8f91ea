"""Operators of the training-data pipeline.

Each module holds one problem; ``queries`` gathers their driver queries. Nothing outside this
subpackage imports it.
"""
