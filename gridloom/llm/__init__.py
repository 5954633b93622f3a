"""Training-data operators: quality, extraction, scanning, tokenising, deduplication, decontamination."""
