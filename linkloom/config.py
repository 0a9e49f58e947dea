"""Parameters of the similarity pipeline."""

from __future__ import annotations

import struct
from dataclasses import dataclass


def single(x: float) -> float:
    """``x`` rounded to single precision, as a double."""
    return struct.unpack("f", struct.pack("f", x))[0]


@dataclass(frozen=True)
class Params:
    """Defaults of the pipeline. ``decay`` and ``threshold`` act as single-precision numbers.

    ``prune``: "partial" drops each partial product below the threshold before
    summing, "sum" drops sums. ``in_place``: a side is updated from the other
    side's newest values; else from those of the round before. ``evidence_default``
    stands in for pairs without common neighbours.
    """

    decay: float = 0.6
    threshold: float = 0.001
    min_clicks: int = 0
    iterations: int = 3
    in_place: bool = True
    prune: str = "partial"
    evidence_default: float = 0.48
    float32_scores: bool = True

    def __post_init__(self) -> None:
        if not 0 < self.decay <= 1:
            raise ValueError("decay must lie in (0, 1]")
        if not 0 < self.evidence_default <= 0.5:
            raise ValueError("evidence_default must lie in (0, 0.5]")
        if self.iterations < 1 or (self.in_place and self.iterations < 2):
            raise ValueError("in place at least two iterations are needed, else one")
        if self.prune not in ("partial", "sum"):
            raise ValueError("prune must be 'partial' or 'sum'")
        object.__setattr__(self, "decay", single(self.decay))
        object.__setattr__(self, "threshold", single(self.threshold))
