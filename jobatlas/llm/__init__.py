"""Operators that prepare training text: filters, deduplication, decontamination, scans, packing, archives."""
