"""Operators that a training-data pipeline needs beside the analytics engine.

Nothing outside this subpackage imports it. Each module holds one operator with
a general interface on DataFrames; ``queries`` applies them to the test tables.
"""
