"""Operators for large-scale training-data preparation.

Nothing outside this folder (and corpus_pipeline.py) imports it.
"""
