"""All registered queries by name, with their SQL where SQL can express them."""

from __future__ import annotations

from ..session import query
from . import cohort, extras, fits, ledgers, lints, mining, pairing, parsing, people, prose, reports, roundtrips, texts

_parts = (reports, pairing, cohort, ledgers, lints, parsing, texts, prose, mining, roundtrips, people, extras, fits)
QUERIES = {k: query(v) for p in _parts for k, v in p.QUERIES.items()}
SQL = {k: v for p in _parts for k, v in p.SQL.items()}
