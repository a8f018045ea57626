"""Functions of the block-redundancy engine."""
