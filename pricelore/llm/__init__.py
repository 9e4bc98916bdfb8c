"""Training-data operators: search, scans, deduplication, scoring, mixing, packing and file formats."""
