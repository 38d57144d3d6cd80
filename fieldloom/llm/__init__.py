"""Training-data operators: media columns, classifiers, near-duplicates, packing and mixing.

Nothing else in the library imports this subpackage; it can be deleted without touching the rest.
"""
