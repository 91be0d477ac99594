"""Readers and writers: JSONL, CSV, XML/markup corpora, feature store."""
