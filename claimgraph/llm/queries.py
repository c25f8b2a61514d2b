"""The queries of this subpackage and their SQL, by name."""

from claimgraph.llm import bpe, embedding_dedup, licenses, line_dedup, mixing, notices, periodic, pieces, quality, secrets, simhash, substrings, topk, whitening

_MODULES = (line_dedup, licenses, notices, mixing, topk, simhash, embedding_dedup, quality, secrets, substrings, bpe, pieces, whitening, periodic)


def queries() -> dict:
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
