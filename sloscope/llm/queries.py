"""All queries of the subpackage and their DuckDB SQL."""

from sloscope.llm import bpe, exact_dedup, filter_audit, licences, line_dedup, minhash, packing, pii, quality, simhash, spelling, suffix_dedup, url_filters

_MODULES = (exact_dedup, line_dedup, suffix_dedup, quality, simhash, url_filters, licences, packing, bpe, pii, minhash, spelling, filter_audit)

QUERIES = {name: run for module in _MODULES for name, run in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
