"""Streaming of the block-redundancy engine."""
