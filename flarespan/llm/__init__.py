"""Operators for preparing training text at scale.

Every operator takes a ``documents``-shaped DataFrame (at least ``doc_id`` and ``text``) and reads
only the columns it names, so extra columns, whatever their names, neither clash nor pass through.
"""
