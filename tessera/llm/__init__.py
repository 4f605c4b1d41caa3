"""Operators for training-data pipelines. QUERIES and ORACLES are read by __spark_entry__.py alone."""

from __future__ import annotations

from importlib import import_module

MODULES = ("bpe", "centroids", "jpeg", "kneser_ney", "language_gru", "merkle", "mixing", "pii_feistel", "quality_cnn", "rules_js", "simhash", "voronoi", "warc")

QUERIES: dict = {}
ORACLES: dict = {}
for _name in MODULES:
    _module = import_module(f"tessera.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= getattr(_module, "ORACLES", {})
