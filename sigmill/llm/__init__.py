"""Operators over text corpora and embeddings for training-data preparation.

Nothing outside this package imports it; ``registry`` lists its queries.
"""
