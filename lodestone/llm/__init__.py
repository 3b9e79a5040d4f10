"""Operators for preparing training text: cleaning, deduplication, scanning, packing, sharding."""
