"""Training-data operators: deduplication, scans, packing, mixing, quality, media and chat formatting."""
