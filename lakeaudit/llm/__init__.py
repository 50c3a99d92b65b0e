"""Training-data operators: quality, deduplication, decontamination, extraction, packing, search.

Nothing outside this folder and ``corpus_pipeline.py`` imports it.
"""
