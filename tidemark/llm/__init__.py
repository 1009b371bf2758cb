"""Training-data operators: deduplication, decontamination, extraction, mixing and encoding of corpora."""
