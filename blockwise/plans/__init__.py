"""Plans of the block-redundancy engine."""
