"""Training-data operators: mixing, deduplication, token counts, filters, packing and scoring.

Nothing outside this folder imports it, except ``__spark_entry__.py`` (guarded) and ``corpus_pipeline.py``.
"""
