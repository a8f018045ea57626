"""Sources of the block-redundancy engine."""
