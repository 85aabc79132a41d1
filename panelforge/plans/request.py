"""A study's request: where its prices come from, what is checked before a plan is made, and what identifies a run."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ASSETS, RF_MODES, Config
from ..functions import hashing
from ..operators import metrics
from ..operators.alignment import simple_returns
from ..operators.riskfree import as_of
from ..sources.panel import asset_dim, panel_slice
from . import sample, study

#: Sources whose window the request sets.
WINDOWED = ("frozen", "live")
FROZEN_CURRENCY = "EUR"
#: How far a normalised base weight, rounded to four digits, may be from the base allocation's.
TOLERANCE = 1e-6


@dataclass(frozen=True)
class Request:
    scenario: str | None = "S1"
    source: str = "frozen"
    assets: tuple[str, ...] | None = None
    start: str = "1995-01-01"
    end: str = "2001-12-31"
    base_currency: str = "EUR"
    target_vol: float = 0.30
    traditional_weights: tuple[tuple[str, float], ...] | None = None
    rf_mode: str = "fixings"

    def __post_init__(self) -> None:
        if self.rf_mode not in RF_MODES:
            raise ValueError(f"rf_mode is one of {tuple(RF_MODES)}, not {self.rf_mode!r}")

    def spec(self) -> sample.SampleSpec:
        """The named sample, which sets members and window, or one of the request's own."""
        if self.scenario:
            return sample.scenario(self.scenario)
        members = tuple(a for a, kind, *_ in ASSETS if kind == "crypto" and (self.assets is None or a in self.assets))
        return sample.SampleSpec("custom", "custom", self.start, self.end, members)


def check_currency(request: Request) -> None:
    """A frozen panel is in one currency; another label on it would be wrong."""
    if request.source == "frozen" and request.base_currency.upper() != FROZEN_CURRENCY:
        raise ValueError(f"the frozen panel is in {FROZEN_CURRENCY}; {request.base_currency} needs a live source")


def prices(request: Request, sources: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """The requested assets that the source has, in the request's window where the source has one.

    Unknown sources, no asset at all and an empty window are errors.
    """
    check_currency(request)
    if request.source not in sources:
        raise ValueError(f"unknown source {request.source!r}; known: {sorted(sources)}")
    found = sources[request.source]()
    if request.assets is not None:
        found = panel_slice(found, list(request.assets))
        if found.isEmpty():
            raise ValueError(f"none of the assets {list(request.assets)} is in the source")
    if request.source in WINDOWED:
        found = panel_slice(found, None, request.start, request.end)
        if found.isEmpty():
            raise ValueError(f"no price between {request.start} and {request.end}")
    return found


def traditional_split(request: Request, assets: tuple = ASSETS) -> dict[str, float]:
    """The base split: the request's weights of known traditional assets above zero, or the configured ones if none is left."""
    base = {a: w for a, kind, w, _ in assets if kind == "traditional"}
    own = {a: float(w) for a, w in request.traditional_weights or () if a in base and w > 0}
    return own or base


def is_base_allocation(split: dict[str, float], assets: tuple = ASSETS) -> bool:
    """Is the split, scaled to one, the configured one?"""
    base = {a: w for a, kind, w, _ in assets if kind == "traditional"}
    whole, total = sum(base.values()), sum(split.values()) or 1.0
    return all(abs(round(split.get(a, 0.0) / total, 4) - round(w / whole, 4)) < TOLERANCE for a, w in base.items())


def with_split(dim: DataFrame, split: dict[str, float]) -> DataFrame:
    """The asset dimension with the base weights of a split; traditional assets without one weigh nothing."""
    weight = F.lit(0.0)
    for asset, w in split.items():
        weight = F.when(F.col("asset") == asset, F.lit(float(w))).otherwise(weight)
    return dim.withColumn("base_weight", F.when(F.col("asset_class") == "crypto", F.col("base_weight")).otherwise(weight))


def _digest(value) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()[:16]


def rates_digest(rates: DataFrame) -> str:
    """16 hex digits over dates and annual rates."""
    rows = rates.select("date", F.lit("rate").alias("asset"), F.col("rf_annual").alias("r"))
    return hashing.panel_hash(rows).first().dataset_hash


def run_spec(request: Request, cfg: Config, rates: DataFrame | None = None) -> dict:
    """Every setting that can move a number, and the digest of the rates where they are a series."""
    spec = {f"request.{k}": v for k, v in asdict(request).items()} | {f"config.{k}": v for k, v in asdict(cfg).items()}
    spec["weights"] = sorted(traditional_split(request).items())
    spec["rates"] = None if rates is None or RF_MODES[request.rf_mode] == "constant" else rates_digest(rates)
    return spec


def fingerprint(returns: DataFrame, spec: dict) -> dict:
    """What a report cites: the hash of the data (rounded, and bit by bit), that of data and settings, rows, columns, window."""
    found = hashing.panel_hash(returns).first()
    exact = returns.select("date", "asset", F.hex(F.col("r").cast("double").cast("string").cast("binary")).alias("bits"))
    parts = exact.agg(F.expr("bit_xor(xxhash64(date, asset, bits))").alias("x"), F.expr("sum(cast(xxhash64(asset, bits, date) as decimal(38, 0)))").alias("s")).first()
    columns = [r.asset for r in returns.select("asset").distinct().orderBy("asset").collect()]  # a name an asset
    return {
        "dataset_hash": found.dataset_hash,
        "run_hash": _digest([found.dataset_hash, spec]),
        "hash_exact": _digest([str(parts.x), str(parts.s)]),
        "rows": found.rows,
        "columns": columns,
        "start": str(found["first"]),
        "end": str(found["last"]),
    }


def analysis_key(returns: DataFrame, request: Request, cfg: Config, rates: DataFrame | None = None) -> str:
    """The key of a precomputed inference: data and every setting, the crypto share, targets and grids among them."""
    return fingerprint(returns, run_spec(request, cfg, rates))["run_hash"]


@dataclass(frozen=True)
class Prepared:
    """A request made into a study: inputs, settings, and the builder of point-in-time weights, if its sample has one."""

    inputs: study.Inputs
    cfg: Config
    pit: study.Builder | None
    spec: sample.SampleSpec
    report: DataFrame
    rate: DataFrame


def of_request(request: Request, sources: dict[str, Callable[[], DataFrame]], rates: DataFrame, cfg: Config | None = None) -> Prepared:
    """The study that a request asks for.

    A named sample sets members and window, so the request's own assets and dates count only without one. The split of the traditional assets goes into the
    dimension, rate mode and target volatility into the settings: the target is among the studied ones afterwards. In the modes of a
    constant rate `cfg.rf_annual` is that of every date.
    """
    cfg = cfg or Config()
    vols = cfg.target_vols if request.target_vol in cfg.target_vols else tuple(sorted({*cfg.target_vols, request.target_vol}))
    cfg = replace(cfg, rf_mode=request.rf_mode, target_vols=vols)
    spec = request.spec()
    asked = replace(request, assets=None, start=spec.start, end=spec.end) if request.scenario else request
    found = prices(asked, sources)
    # assets with a price, and of crypto assets the sample's members
    traded = [r.asset for r in found.select("asset").distinct().collect()]  # a name an asset
    dim = with_split(asset_dim(found.sparkSession, tuple(a for a in ASSETS if a[0] in traded and (a[1] == "traditional" or a[0] in spec.members))), traditional_split(request))
    if request.scenario or request.source in WINDOWED:
        kept = found.join(F.broadcast(dim.select("asset")), "asset", "left_semi").select("date", "asset", "price")
        inputs, pit = study.of_sample(kept, spec, rates, dim)
        report = sample.report(kept, sample.resolve(kept, spec, dim), spec)
    else:  # a source of its own dates: its returns as they are, over its own window
        first, last = found.agg(F.min("date"), F.max("date")).first()
        spec, pit = replace(spec, start=str(first), end=str(last)), None
        returns = simple_returns(found).persist()
        inputs = study.Inputs(returns, rates, dim, as_of(returns.select("date").distinct(), rates, "rf_annual").persist())
        report = sample.report(found, found, spec)
    if inputs.returns.isEmpty():
        raise ValueError(f"{spec.name}: no date on which the assets have returns")
    known = inputs.known.agg(F.lit(request.rf_mode).alias("mode"), F.avg("rf_annual").alias("mean"), F.min("rf_annual").alias("lowest"), F.max("rf_annual").alias("highest"))
    if RF_MODES[request.rf_mode] == "constant":
        known = known.select("mode", *[F.lit(cfg.rf_annual).alias(c) for c in ("mean", "lowest", "highest")])
    return Prepared(inputs, cfg, pit, spec, report, known)


def backtest(request: Request, sources: dict[str, Callable[[], DataFrame]], rates: DataFrame, cfg: Config | None = None) -> DataFrame:
    """strategy, its metrics and the request's limits of every strategy of the requested study."""
    of = of_request(request, sources, rates, cfg)
    table = study.metrics_table(study.run_strategies(of.inputs, of.cfg, of.pit), of.cfg)
    return metrics.limit_flags(table, of.cfg.mdd_limit, of.cfg.cvar_limit)
