"""Driver queries over the core operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from scriptoria.queries import code, corpus

FLAGSHIP = "section_evidence"
QUERIES = corpus.QUERIES | code.QUERIES
SQL = corpus.SQL | code.SQL
