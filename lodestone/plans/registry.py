"""All queries of the library but those of the llm subpackage."""

from __future__ import annotations

from . import curation, entities, quality, search, streams

_ALL = search.QUERIES | entities.QUERIES | curation.QUERIES | quality.QUERIES | streams.QUERIES
QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLES = {name: sql for name, (_, sql) in _ALL.items() if sql}
