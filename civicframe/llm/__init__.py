"""Operators for training-data pipelines: cleaning, scoring, de-duplication, tokenisation, page archives."""
