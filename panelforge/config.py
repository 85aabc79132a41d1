"""Settings of a study, as a frozen dataclass; grids over settings are DataFrames (see plans)."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, fields

#: Class, share of the traditional budget, and trading cost of each asset of the canonical panel.
ASSETS = (
    ("AF", "traditional", 0.6, 10.0),
    ("NF", "traditional", 0.3, 10.0),
    ("RF", "traditional", 0.1, 10.0),
    ("AO", "crypto", 0.0, 25.0),
    ("NO", "crypto", 0.0, 25.0),
    ("RO", "crypto", 0.0, 25.0),
)
#: name, first and last day of the named market phases.
REGIMES = (
    ("early", "1995-01-01", "1996-06-30"),
    ("expansion", "1996-07-01", "1997-12-31"),
    ("stress", "1998-01-01", "1998-12-31"),
    ("recovery", "1999-01-01", "2000-03-31"),
    ("late", "2000-04-01", "2001-12-31"),
)
REBALANCE = ("daily", "weekly", "monthly")
RF_MODES = {"constant": "constant", "manual": "constant", "fixings": "fixings", "simple": "simple"}


@dataclass(frozen=True)
class Config:
    crypto_share: float = 0.10
    target_vols: tuple[float, ...] = (0.15, 0.30, 0.60)
    lookback: int = 13
    trading_days: int = 52
    max_leverage: float = 1.0
    vol_method: str = "rolling"
    halflife: int = 5
    rebalance: str = "daily"
    weight_rebalance: str = "monthly"
    dead_band: float = 0.0
    rf_mode: str = "fixings"
    rf_annual: float = 0.03
    cvar_alpha: float = 0.05
    listing_buffer: int = 30
    parity_lookback: int = 13
    rolling_window: int = 26
    folds: int = 5
    train_share: float = 0.4
    cost_multipliers: tuple[float, ...] = (0.0, 0.5, 1.0, 2.0, 3.0, 5.0)
    stability_lookbacks: tuple[int, ...] = (4, 8, 13, 26, 39)
    stability_vols: tuple[float, ...] = (0.15, 0.25, 0.30, 0.45, 0.60)
    sweep_step: float = 0.025
    sweep_points: int = 21
    bootstrap_n: int = 10_000
    sweep_bootstrap_n: int = 1000
    expected_block: int = 8
    seed: int = 42
    mdd_limit: float | None = None
    cvar_limit: float | None = None
    regimes: tuple[tuple[str, str, str], ...] = field(default=REGIMES)

    def __post_init__(self) -> None:
        if self.rebalance not in REBALANCE:
            raise ValueError(f"rebalance is one of {REBALANCE}, not {self.rebalance!r}")
        if self.rf_mode not in RF_MODES:
            raise ValueError(f"rf_mode is one of {tuple(RF_MODES)}, not {self.rf_mode!r}")
        if self.vol_method not in ("rolling", "ewma"):
            raise ValueError(f"vol_method is rolling or ewma, not {self.vol_method!r}")
        if not 0 <= self.crypto_share <= 1:
            raise ValueError("crypto_share lies between 0 and 1")

    def target(self, vol: float) -> float:
        """vol, if it is one of target_vols."""
        if vol not in self.target_vols:
            raise ValueError(f"target_vol {vol} is not among {self.target_vols}")
        return vol

    def sweep_shares(self) -> list[float]:
        return [round(i * self.sweep_step, 6) for i in range(self.sweep_points)]

    def run_hash(self, dataset_hash: str = "") -> str:
        """16 hex digits over every field and the data."""
        spec = {f.name: asdict(self)[f.name] for f in fields(self)} | {"dataset": dataset_hash}
        return hashlib.sha256(json.dumps(spec, sort_keys=True).encode()).hexdigest()[:16]
