"""Operators of a training-data pipeline over ``documents`` and ``embeddings``.

Nothing outside this folder and ``corpus_pipeline.py`` imports it.
"""
