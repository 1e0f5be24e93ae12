"""Training-data operators: tokens, search, packing, filters, scoring and near-duplicates."""
