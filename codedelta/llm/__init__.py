"""Training-data pipeline operators (quality, deduplication, decontamination, mixing, encoding)."""
