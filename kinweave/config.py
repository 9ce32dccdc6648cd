"""Tunables, each with an environment variable of the same name."""

from __future__ import annotations

import os
from dataclasses import dataclass


# Names of variables and defaults; matches and hashes depend on them.
@dataclass(frozen=True)
class Settings:
    match_threshold: float = float(os.getenv("MATCH_THRESHOLD", "5.0"))
    name_floor: float = float(os.getenv("NAME_MIN_SIMILARITY", "0.80"))
    block_cap: int = int(os.getenv("BLOCK_CAP", "200"))
    hub_limit: int = int(os.getenv("HUB_LIMIT", "50"))
    min_ring: int = int(os.getenv("MIN_RING_SIZE", "3"))
    salt: str = os.getenv("PII_SALT", "dev-salt-change-me")


SETTINGS = Settings()
