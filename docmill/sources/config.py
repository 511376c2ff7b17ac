"""Configuration: signatures and field patterns from YAML or JSON files, as plain tables."""

from __future__ import annotations

import json
from pathlib import Path


def load(path: str | None) -> dict:
    """The file's content; the built-in tables for no path or a file that isn't there. YAML needs its library, JSON
    doesn't."""
    if path is None or not Path(path).exists():
        return default()
    text = Path(path).read_text(encoding="utf-8")
    try:
        return json.loads(text)
    except ValueError:
        import yaml

        return yaml.safe_load(text) or {}


def signatures(config: dict, compat: bool = False) -> dict[str, dict[str, list[str]]]:
    """document_signatures with the literal r'...' of patterns taken off (kept in compat)."""
    strip = lambda p: p if compat or p[:2] not in ("r'", 'r"') else p[2:-1]
    return {kind: {"keywords": list(s.get("keywords", [])), "patterns": [strip(p) for p in s.get("patterns", [])], "exclude": list(s.get("exclude", []))} for kind, s in config.get("document_signatures", {}).items()}


def default() -> dict:
    """The built-in tables in the form of a file."""
    from docmill.operators.classify import SIGNATURES
    from docmill.operators.extract import FIELDS

    fields = {f.name: {"validate": f.validate, "patterns": [{"pattern": p.pattern, "priority": p.priority, "context_keywords": list(p.context_keywords)} for p in f.patterns]} for f in FIELDS}
    return {"document_signatures": SIGNATURES, "field_patterns": fields}
