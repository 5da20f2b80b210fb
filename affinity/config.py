"""Settings of the engine and of the sampler, with their validation."""

from __future__ import annotations

import math
from dataclasses import dataclass

BUY, PV = "buy", "pv"


class ConfigError(ValueError):
    """A setting outside its range."""


def require(ok: bool, message: str) -> None:
    if not ok:
        raise ConfigError(message)


@dataclass(frozen=True)
class EngineConfig:
    """Everything the similarity engine can be told.

    ``max_users_per_item`` drops larger groups when above 0. Groups of up to
    ``exact_max_users_*`` users are paired exactly (-1: always, 0: never), larger ones
    give each user ``max_neighbours_*`` partners. ``sampling`` names the order that
    bounded pairing starts from: ``native`` (md5, portable) or ``compat`` (seeded shuffle).
    """

    delimiter: str = ","
    user_index: int = 0
    item_index: int = 1
    behavior_index: int = 2
    has_header: bool = False
    max_users_per_item: int = -1
    exact_max_users_buy: int = 21
    exact_max_users_pv: int = 5
    max_neighbours_buy: int = 10
    max_neighbours_pv: int = 2
    sample_seed: int = 0x6A09E667F3BCC909
    sampling: str = "native"
    weight_buy: float = 1.0
    weight_pv: float = 0.2
    min_score: float = 0.0
    top_k: int = 50
    min_buy: int = 0
    min_pv: int = 0
    overwrite: bool = False

    def validate(self) -> EngineConfig:
        require(bool(self.delimiter), "delimiter must not be empty")
        for name in ("user_index", "item_index", "behavior_index", "max_neighbours_buy", "max_neighbours_pv", "min_buy", "min_pv"):
            require(getattr(self, name) >= 0, f"{name} must not be negative")
        for name in ("exact_max_users_buy", "exact_max_users_pv"):
            require(getattr(self, name) >= -1, f"{name} must be -1 or more")
        for name in ("weight_buy", "weight_pv", "min_score"):
            require(math.isfinite(getattr(self, name)) and getattr(self, name) >= 0, f"{name} must be finite and not negative")
        require(self.top_k >= 1, "top_k must be at least 1")
        require(self.sampling in ("native", "compat"), "sampling must be native or compat")
        return self

    @property
    def exact_limits(self) -> dict[str, int]:
        return {BUY: self.exact_max_users_buy, PV: self.exact_max_users_pv}

    @property
    def neighbours(self) -> dict[str, int]:
        return {BUY: self.max_neighbours_buy, PV: self.max_neighbours_pv}


@dataclass(frozen=True)
class SamplerConfig:
    """Byte budgets and seed of the user-complete sampler."""

    target_bytes: int = 1_550_000_000
    min_bytes: int = 1_500_000_000
    max_bytes: int = 1_600_000_000
    seed: int = 20260703
    header: str = "auto"
    write_header: bool = False

    def validate(self) -> SamplerConfig:
        require(0 < self.min_bytes <= self.target_bytes <= self.max_bytes, "require 0 < min <= target <= max bytes")
        require(self.header in ("auto", "yes", "no"), "header must be auto, yes or no")
        return self
