"""Options of the reduction, and their checks."""

from __future__ import annotations

from dataclasses import dataclass, field


def ratio(name: str, value: float, top: float = 1.0) -> float:
    if not 0 <= value <= top:
        raise ValueError(f"{name} must be between 0 and {top:g}, not {value}")
    return value


def choice(name: str, value: str, known: dict[str, str]) -> str:
    got = known.get(value.lower())
    if got is None:
        raise ValueError(f"{name} must be one of {', '.join(sorted(set(known.values())))}, not {value!r}")
    return got


STRATEGIES = {"cart": "cart", "quantile": "quantile"}
MONOTONICITY = {"none": "none", "ascending": "ascending", "asc": "ascending", "descending": "descending", "desc": "descending", "peak": "peak", "valley": "valley", "auto": "auto"}


@dataclass(frozen=True)
class SolverConfig:
    """time_limit and gap are taken for compatibility; the merge is exact and needs neither."""

    monotonicity: str = "none"
    time_limit: float = 30.0
    gap: float = 0.01
    min_bin_samples: float = 5.0

    def __post_init__(self):
        object.__setattr__(self, "monotonicity", choice("monotonicity", self.monotonicity, MONOTONICITY))
        ratio("gap", self.gap)


@dataclass(frozen=True)
class ReduceConfig:
    target: str
    event: str | None = None
    non_event: str | None = None
    weight: str | None = None
    missing_threshold: float = 0.30
    gini_threshold: float = 0.05
    correlation_threshold: float = 0.40
    num_bins: int = 10
    prebins: int = 20
    strategy: str = "cart"
    min_category_samples: int = 5
    cart_min_bin_pct: float | None = 5.0
    use_solver: bool = True
    solver: SolverConfig = field(default_factory=SolverConfig)
    drop_columns: tuple[str, ...] = ()

    def __post_init__(self):
        for name in ("missing_threshold", "gini_threshold", "correlation_threshold"):
            ratio(name, getattr(self, name))
        if self.cart_min_bin_pct is not None:
            ratio("cart_min_bin_pct", self.cart_min_bin_pct, 100)
        object.__setattr__(self, "strategy", choice("strategy", self.strategy, STRATEGIES))
        if (self.event is None) != (self.non_event is None):
            raise ValueError("event and non_event have to be given together")
