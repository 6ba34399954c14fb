"""Operators for training-data pipelines.

Nothing outside this package imports it.  Every operator takes and returns DataFrames; the
module docstrings state the method, the result for odd inputs and what bounds its memory.
"""
