"""Operators for preparing training corpora, one module each, and their queries.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
