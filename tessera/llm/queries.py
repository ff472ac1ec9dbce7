"""The queries opN_<name> and their SQL, gathered from the operators' modules."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLES: dict = {}

for _name in ("packing", "minhash", "toxicity", "langid", "mixing", "pii", "warc", "topk", "graphdedup", "suffixes", "decontamination", "filteraudit", "clickdedup"):
    _module = importlib.import_module(f"tessera.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
