"""Operators for preparing training text: archives, quality, duplicates, packing, privacy, licences."""
