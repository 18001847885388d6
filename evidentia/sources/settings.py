"""Configuration: nested defaults, deep merge, overrides from the environment."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping

DEFAULTS: dict = {
    "crawler": {"max_depth": 2, "max_pages": 500, "concurrency": 8, "relevance_threshold": 0.45},
    "chunker": {"strategy": "sentence", "chunk_size": 512, "overlap": 64, "min_length": 100},
    "search": {"top_k_retrieval": 30, "top_k_output": 10, "min_score": 0.15, "diversity_threshold": 0.85, "max_per_domain": 3},
    "cache": {"ttl_html": 3600, "ttl_embeddings": 86400},
    "frontier": {"capacity": 100000},
}


def merge(base: Mapping, extra: Mapping) -> dict:
    """base with extra laid over it; nested mappings merge, anything else replaces."""
    out = dict(base)
    for k, v in extra.items():
        out[k] = merge(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def _like(text: str, example: object) -> object:
    """text as the type of the value it overrides."""
    if isinstance(example, bool):
        return text.strip().lower() in ("1", "true", "yes", "on")
    for kind in (int, float):
        if isinstance(example, kind):
            return kind(text)
    return json.loads(text) if isinstance(example, list | dict) else text


def load(extra: Mapping | None = None, environ: Mapping[str, str] | None = None) -> dict:
    """Defaults, then extra, then SECTION__KEY variables of the environment."""
    out = merge(DEFAULTS, extra or {})
    for name, value in (os.environ if environ is None else environ).items():
        section, _, key = name.lower().partition("__")
        if key and isinstance(out.get(section), dict) and key in out[section]:
            out[section][key] = _like(value, out[section][key])
    return out
