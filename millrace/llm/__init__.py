"""Operators for training corpora: cleaning, deduplication, decontamination, privacy, packing."""
