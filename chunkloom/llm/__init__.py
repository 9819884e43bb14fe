"""Training-data operators. Nothing else in the library imports this subpackage."""

from __future__ import annotations

import importlib

_NAMES = (
    "vector_graph",
    "chat_tools",
    "kk_sharding",
    "redirect_filter",
    "chunk_dedup",
    "bestfit_packing",
    "chosen_path",
    "toxicity_gru",
    "decontaminate",
    "pairwise_quality",
)


def _modules() -> list:
    return [importlib.import_module(f"chunkloom.llm.{n}") for n in _NAMES]


def queries() -> dict:
    """The opN queries by name; each takes (spark, sf_dir)."""
    out: dict = {}
    for m in _modules():
        out.update(m.QUERIES)
    return out


def oracle_sql() -> dict:
    """DuckDB SQL of those queries that SQL can express."""
    out: dict = {}
    for m in _modules():
        out.update(getattr(m, "ORACLE_SQL", {}))
    return out
