"""Operators of the block-redundancy engine."""
