"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from . import queries_corpus, queries_search, queries_text

QUERIES = {**queries_search.QUERIES, **queries_text.QUERIES, **queries_corpus.QUERIES}
SQL = {**queries_search.SQL, **queries_text.SQL, **queries_corpus.SQL}
