"""Training-data operators: scoring, encoding, mixing, filtering and near-duplicate search."""
