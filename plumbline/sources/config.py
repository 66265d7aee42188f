"""Run settings from a JSON or YAML file, with paths relative to a root."""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterable, Mapping
from pathlib import Path


def load_config(path: str) -> dict:
    """The file as a dict; YAML needs the yaml package."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading YAML needs the yaml package; JSON works without") from e
        return yaml.safe_load(text)
    return json.loads(text)


def with_paths(config: Mapping, fields: Iterable[str], root: str) -> dict:
    """A copy in which the named fields, where set and relative, stand under ``root``."""
    out = dict(config)
    for f in fields:
        if out.get(f) and not posixpath.isabs(out[f]) and "://" not in out[f]:
            out[f] = posixpath.join(root, out[f])
    return out


def cache_folder(config: Mapping, kind: str, split: str) -> str | None:
    """Folder of cached features of a kind for a split; None if that cache is off."""
    if not config.get(f"{kind}_cache", False):
        return None
    return posixpath.join(config[f"{kind}_cache_dir"], split)
