"""Corpus operators: one module for each operator, all on (doc_id, text) DataFrames."""
