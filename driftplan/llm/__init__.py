"""Training-data operators: mixing, deduplication, packing, classifiers, token counts and personal data."""
