"""Training-data operators: language ID, near-duplicates, decontamination,
secret scans, surrogates for personal data, language-model scoring, packing,
sharding, chat formatting and nearest neighbours.

Nothing else in the library imports this subpackage.
"""
