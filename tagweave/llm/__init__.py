"""Operators for preparing training corpora: scoring, deduplication, decontamination, mixing, chat formatting.

Nothing outside this folder, ``corpus_pipeline.py`` and ``tests/llm`` imports it.
"""
