"""Operators for preparing training text: deduplication, decontamination, quality, toxicity, formatting, mixing."""
