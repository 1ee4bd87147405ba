"""Operators for training-data pipelines, each a Spark job over ``documents``, ``benchmark``, ``labels`` or ``embeddings``."""
