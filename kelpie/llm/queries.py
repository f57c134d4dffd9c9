"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

#: In each module the functions named op<N>_... are queries; SQL has their twins.
MODULES = ("token_files", "suffix_dedup", "quality", "toxicity", "exact_dedup", "mixing", "tree_bpe", "ngram_lm", "near_dedup", "secrets", "periodic_runs", "importance", "packing")


def _modules():
    return [import_module(f"{__package__}.{m}") for m in MODULES]


def queries() -> dict:
    return {k: f for m in _modules() for k, f in vars(m).items() if k.startswith("op") and k[2:3].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _modules() for k, s in getattr(m, "SQL", {}).items()}
