"""Registry of this subpackage's queries and their SQL."""

from __future__ import annotations

from . import decontaminate, filter_audit, html_text, licenses, lm, packing, pii, prefix_trie, quality, secrets, simhash, url_filter, warc

_MODULES = [decontaminate, lm, html_text, simhash, licenses, packing, pii, quality, secrets, url_filter, warc, prefix_trie, filter_audit]

QUERIES = {}
ORACLES = {}
for _m in _MODULES:
    for _k, _v in vars(_m).items():
        if _k.startswith("op") and _k[2:3].isdigit():
            QUERIES[_k] = _v
            if getattr(_m, "ORACLE", None):
                ORACLES[_k] = _m.ORACLE
