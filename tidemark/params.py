"""Parameters of a run; their values become literals in the plans."""

from __future__ import annotations

import datetime
from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    exchanges: tuple[str, ...] = ("NASDAQ", "NYSE", "AMEX")
    min_price: float = 0.5
    min_volume: float = 100_000.0
    spiker_threshold: float = 15.0
    grinder_threshold: float = 0.5
    grinder_days: int = 3
    min_rel_volume: float = 0.8
    top_k: int = 5000
    lags: tuple[int, ...] = (1, 3, 5, 10, 30)
    lookback_days: int = 90
    min_bars: int = 50
    min_samples: int = 30
    confidence_level: float = 0.95
    retention_days: int = 90
    #: The day a snapshot stands for; None is today.
    as_of: datetime.date | None = None

    def __post_init__(self) -> None:
        if self.lookback_days < 1:
            raise ValueError("lookback_days must be 1 or more")


#: For bars made of the order lines: volumes there average about a hundred.
LINE_BARS = Params(min_volume=35.0)
