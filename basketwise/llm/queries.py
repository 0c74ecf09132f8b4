"""The registered queries of this folder, and their SQL."""

from __future__ import annotations

from basketwise.llm import (
    byte_bpe, collocations, decontaminate, exact_dedup, hidden_markov, language_id, merkle, ngram_join, packing, page_text, paragraph_dedup, secret_scan, url_filter,
)

_MODULES = (secret_scan, exact_dedup, url_filter, byte_bpe, ngram_join, language_id, decontaminate, paragraph_dedup, hidden_markov, page_text, merkle, collocations, packing)

#: Every function named op<number>_... of the operators' modules.
QUERIES = {
    name: query
    for module in _MODULES
    for name, query in vars(module).items()
    if name.startswith("op") and name[2].isdigit() and callable(query)
}
QUERIES["pages_language"] = language_id.pages_language
SQL = {name: sql for module in _MODULES for name, sql in getattr(module, "SQL", {}).items()}
