"""All queries of this package."""

from __future__ import annotations

from millrace.llm import byte_bpe, leakage, lookalike, packing, residue, sentences, splitting

_MODULES = (byte_bpe, leakage, lookalike, packing, residue, sentences, splitting)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
