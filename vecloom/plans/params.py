"""Parameters of building and searching, with their defaults and checks."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

from vecloom.functions.vectors import parse_metric


@dataclass(frozen=True)
class BuildParams:
    """m: hyperplanes of a residual code (at most 16); l_max: reservoir and candidate cap; r: out-degree cap;
    alpha: slack of diversity pruning; fanout: leaves of a point; c_max: rows of a leaf; runs: partitionings;
    c_min is accepted and not used; norm_mode: 'bf16' rounds reservoir distances to 8 bits, 'exact' does not."""

    # fixed values: the published defaults
    metric: str = "euclidean"
    m: int = 12
    l_max: int = 64
    r: int = 64
    alpha: float = 1.2
    fanout: int = 2
    c_min: int = 256
    c_max: int = 2048
    runs: int = 1
    seed: int = 0
    norm_mode: str = "bf16"

    def __post_init__(self):
        object.__setattr__(self, "metric", parse_metric(self.metric))
        object.__setattr__(self, "runs", max(self.runs, 1))
        if not 1 <= self.m <= 16:
            raise ValueError("m must be in 1..16")
        for name in ("l_max", "r", "fanout", "c_max"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")
        if self.norm_mode not in ("bf16", "exact"):
            raise ValueError("norm_mode is 'bf16' or 'exact'")

    def with_(self, **changes) -> BuildParams:
        return replace(self, **changes)


@dataclass(frozen=True)
class SearchParams:
    """beam: candidates a search keeps (raised to what it returns); strategy of self-kNN: auto, exact, beam, warm or reservoir."""

    beam: int = 64
    strategy: str = "auto"
    refine: bool = True

    def __post_init__(self):
        if self.strategy not in ("auto", "exact", "beam", "warm", "reservoir", "hnsw", "ivf"):
            raise ValueError(f"unknown strategy: {self.strategy!r}")


@dataclass(frozen=True)
class HnswParams:
    # fixed values: the published defaults
    m: int = 16
    ef_construction: int = 200
    ef_search: int = 64
    quantize: str | None = None

    def __post_init__(self):
        if self.quantize not in (None, "none", "sq8"):
            raise ValueError("quantize is None or 'sq8'")


@dataclass(frozen=True)
class IvfParams:
    nlist: int | None = None
    nprobe: int = 16
    pq_m: int | None = None
    options: dict = field(default_factory=dict)

    def lists(self, n: int) -> int:
        """Round 4 sqrt(n), within 16 and 4,096, and never more than the points."""
        return max(1, min(n, self.nlist or min(max(round(4 * n**0.5), 16), 4096)))


def names(kind: type) -> list[str]:
    return [f.name for f in fields(kind)]
