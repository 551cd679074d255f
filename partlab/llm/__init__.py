"""Operators for large-scale training-data pipelines.

Every module here is self-contained on top of :mod:`partlab.llm.common`; nothing outside
this subpackage imports it.
"""
