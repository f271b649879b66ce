"""Training-data operators: packing, quality, deduplication, decontamination, archives, models and token files."""
