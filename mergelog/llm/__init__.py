"""Training-data operators: near-duplicates, token files, packing, formatting, scoring and search."""
