"""Training-data operators: sharding, tokenising, quality, licences,
near-duplicates, language, nearest neighbours, secrets and packing.

Nothing else in the library imports this package.
"""
