"""All queries of the core, by name."""

from __future__ import annotations

from textlode.plans import keys, retrieval, roundtrips

FLAGSHIP = "topk_cosine"
QUERIES = {**retrieval.QUERIES, **keys.QUERIES, **roundtrips.QUERIES}
SQL = {**retrieval.SQL, **keys.SQL, **roundtrips.SQL}
