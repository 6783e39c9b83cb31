"""Training-data operators: dedup, PII, decontamination, tokenisation, archives, language ID, extraction.

Nothing outside this folder and ``corpus_pipeline.py`` imports it.
"""
