"""Operators for preparing training text: scoring, deduplication, filtering, mixing, fingerprints."""
