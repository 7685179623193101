"""Operators of a training-data pipeline: packing, tokens, classifiers, licence and secret scans, near duplicates.

Nothing else in the library imports this subpackage."""
