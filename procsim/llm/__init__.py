"""Operators of a large-scale training-data pipeline.

Nothing else in ``procsim`` imports this subpackage; its queries are registered
by ``procsim.llm.queries``.
"""
