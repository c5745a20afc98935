"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import alignment, decontam, exact, mixing, oracles, ranked, secret_scan, sentencepieces, simhash, substring, suffix, tokens, toxicity, warc

MODULES = (tokens, simhash, exact, suffix, secret_scan, decontam, mixing, warc, substring, toxicity, ranked, sentencepieces, alignment)
QUERIES = {name: fn for m in MODULES for name, fn in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()} | oracles.SQL
