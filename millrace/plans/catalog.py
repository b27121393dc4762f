"""All queries of the core library."""

from __future__ import annotations

from millrace.plans import contracts, corpus, index, keyed, messages, streams

_MODULES = (messages, corpus, keyed, contracts, index, streams)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
FLAGSHIP = index.search_topk
