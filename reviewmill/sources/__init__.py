"""Readers and writers: raw review files, corpora, tables, published models."""
