"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from lodestrata.llm import p1_linkage, p2_spellings, p6_batches, p7_characters, p8_leakage, p9_mixing, p10_languages

_MODULES = (p1_linkage, p2_spellings, p6_batches, p7_characters, p8_leakage, p9_mixing, p10_languages)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in _MODULES for k, v in m.ORACLE.items()}
