"""Training-data operators: scoring, language, packing, chat windows, fingerprints, de-duplication, mixing, search."""
