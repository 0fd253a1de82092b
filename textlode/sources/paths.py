"""Keeping file paths inside a base directory."""

from __future__ import annotations

from pathlib import Path


def safe_path(base: str, path: str | None) -> str | None:
    """The resolved path if it lies within ``base``, links followed; None for blank paths and any that leave it."""
    if path is None or not str(path).strip():
        return None
    root = Path(base).resolve()
    try:
        full = (root / path).resolve()
    except (OSError, RuntimeError, ValueError):
        return None
    return str(full) if full == root or root in full.parents else None
