"""Corpus operators for training-data pipelines: search, archives, language-model scores, token files,
secret scans, near-duplicates, fingerprints, mixing, packing and quality.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
