"""Settings from TOML: frozen, checked, with tiers overridden in part."""

from __future__ import annotations

import tomllib
from dataclasses import replace

from corpusloom.operators.manifest import RHYTHM, TIERS, Config, Versions


def load(text: str) -> Config:
    """[tiers.NAME] floor, ceiling, tombstone, failures and [versions]; a tier that does not exist, or bounds that contradict, are errors."""
    raw = tomllib.loads(text)
    rhythm = dict(RHYTHM)
    for name, change in raw.get("tiers", {}).items():
        if name not in TIERS:
            raise ValueError(f"no such tier: {name}")
        rhythm[name] = replace(rhythm[name], **change)
    return Config(rhythm, replace(Versions(), **raw.get("versions", {})))
