"""The parameter profile: what a user may move, and what follows from it.

Everything here is computed once on the driver and enters plans as literals.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, replace


@dataclass(frozen=True)
class Radius:
    air_km_max: float = 80.0
    driving_soft: float | None = None
    driving_hard: float | None = None
    require_driving_check: bool = True

    @property
    def effective_soft(self) -> float:
        return self.driving_soft if self.driving_soft is not None else round(self.air_km_max * 1.25, 1)

    @property
    def effective_hard(self) -> float:
        return self.driving_hard if self.driving_hard is not None else round(self.air_km_max * 1.45, 1)


@dataclass(frozen=True)
class Budget:
    total_max: float = 1_200_000.0
    exceptional: float | None = None
    total_hard: float | None = None
    target: float | None = None
    negotiation: float | None = None
    purchase_hard: float | None = None
    purchase_share: float = 0.625
    acquisition_parts: tuple[float, ...] = (0.035, 0.015, 0.005, 0.0357)

    @staticmethod
    def _thousands(own: float | None, value: float) -> float:
        return float(own) if own is not None else float(round(value, -3))

    @property
    def purchase_target(self) -> float:
        return self._thousands(self.target, self.total_max * self.purchase_share)

    @property
    def purchase_negotiation(self) -> float:
        return self._thousands(self.negotiation, self.purchase_target * 1.133)

    @property
    def purchase_hard_max(self) -> float:
        return self._thousands(self.purchase_hard, self.purchase_target * 1.20)

    @property
    def total_exceptional(self) -> float:
        return self._thousands(self.exceptional, self.total_max * 1.125)

    @property
    def total_hard_max(self) -> float:
        return self._thousands(self.total_hard, self.total_max * 1.25)

    @property
    def acquisition(self) -> float:
        return sum(self.acquisition_parts)


@dataclass(frozen=True)
class Weights:
    fit: float = 0.35
    deal: float = 0.25
    hidden: float = 0.15
    freshness: float = 0.15
    confidence: float = 0.10

    def normalised(self) -> Weights:
        total = sum(asdict(self).values())
        if abs(total - 1) < 1e-9:
            return self
        return Weights(**{k: v / total for k, v in asdict(self).items()}) if total > 0 else Weights()


@dataclass(frozen=True)
class Gates:
    shortlist_confidence: float = 70.0
    keep_confidence: float = 60.0
    renovation_risk_ratio: float = 1.5
    exceptional_development: float = 8.0
    reject_removed: bool = True
    reject_excluded: bool = True
    reject_unrouted: bool = False
    triage_probability: float = 0.85
    stale_days: int = 45
    unverified_stale_days: int = 180
    shortlist_size: int = 10
    review_size: int = 100


@dataclass(frozen=True)
class Renovation:
    light: tuple[float, float] = (300.0, 600.0)
    medium: tuple[float, float] = (700.0, 1200.0)
    heavy: tuple[float, float] = (1300.0, 2000.0)
    complete: tuple[float, float] = (2000.0, 2800.0)
    roof_per_sqm: float = 350.0
    outbuilding_per_sqm: float = 450.0
    utilities: float = 80_000.0
    contingency: float = 0.20
    capex: float = 25_000.0
    pre_modern_year: int = 1960
    modern_year: int = 1995

    def __post_init__(self) -> None:
        if self.modern_year < self.pre_modern_year:
            raise ValueError("modern_year lies before pre_modern_year")


@dataclass(frozen=True)
class Profile:
    name: str = "default"
    centre: tuple[float, float] = (47.907, 11.840)
    radius: Radius = field(default_factory=Radius)
    budget: Budget = field(default_factory=Budget)
    land_preferred: float = 2000.0
    land_strong: float = 5000.0
    weights: Weights = field(default_factory=Weights)
    gates: Gates = field(default_factory=Gates)
    renovation: Renovation = field(default_factory=Renovation)
    coverage: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        object.__setattr__(self, "weights", self.weights.normalised())

    @property
    def profile_hash(self) -> str:
        """Equal for profiles that score alike: name and coverage don't enter."""
        payload = {k: v for k, v in asdict(self).items() if k not in ("name", "coverage")}
        return hashlib.blake2s(json.dumps(payload, sort_keys=True).encode(), digest_size=12).hexdigest()

    def with_sliders(self, air_km: float | None = None, total_budget: float | None = None) -> Profile:
        """Sliders clamp to their ranges; moving the budget lets the purchase limits follow it again."""
        out = self
        if air_km is not None:
            out = replace(out, radius=replace(out.radius, air_km_max=float(min(200.0, max(10.0, air_km)))))
        if total_budget is not None:
            out = replace(out, budget=replace(out.budget, total_max=float(min(3e6, max(2e5, total_budget))), target=None, negotiation=None, purchase_hard=None))
        return out


#: The two parameter sets: what the code assumes, and what is shipped as configuration.
BUILT_IN = Profile()
SHIPPED = Profile(
    name="shipped",
    land_preferred=1000.0,
    gates=Gates(shortlist_confidence=60.0, keep_confidence=50.0),
    renovation=Renovation(light=(200.0, 500.0), medium=(600.0, 1100.0), heavy=(1200.0, 1900.0), complete=(1900.0, 2700.0)),
)
PROFILES = {p.name: p for p in (BUILT_IN, SHIPPED)}
