"""Parameters of the engine: windows, stock policy, forest."""

from __future__ import annotations

from dataclasses import dataclass
from math import gcd

from .constants import KPI_UNIT_PRICE

_UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def to_seconds(duration: str) -> int:
    """``"5 minutes"`` -> 300, ``"1 hour 30 minutes"`` -> 5400, ``"3000 milliseconds"`` -> 3.

    Windows are cut in whole seconds; other durations are refused.
    """
    words = duration.removeprefix("interval ").split()
    milliseconds = 0
    for amount, unit in zip(words[::2], words[1::2], strict=True):
        name = unit.lower().rstrip("s")
        milliseconds += int(amount) * (1 if name == "millisecond" else 1000 * _UNIT_SECONDS[name])
    if not words or milliseconds % 1000:
        raise ValueError(f"{duration!r} is not a whole number of seconds")
    return milliseconds // 1000


@dataclass(frozen=True)
class WindowSpec:
    """A sliding event-time window; ``slide == window`` makes it tumbling."""

    window: str = "5 minutes"
    slide: str = "1 minute"
    watermark: str = "10 minutes"

    def __post_init__(self) -> None:
        if not 0 < self.slide_seconds <= self.window_seconds:
            raise ValueError(f"slide {self.slide} must be within (0, {self.window}]")

    @classmethod
    def tumbling(cls, window: str, watermark: str = "10 minutes") -> WindowSpec:
        return cls(window, window, watermark)

    @property
    def window_seconds(self) -> int:
        return to_seconds(self.window)

    @property
    def slide_seconds(self) -> int:
        return to_seconds(self.slide)

    @property
    def is_tumbling(self) -> bool:
        return self.slide_seconds == self.window_seconds

    @property
    def pane_seconds(self) -> int:
        """Longest interval that never straddles a window border."""
        return gcd(self.window_seconds, self.slide_seconds)

    @property
    def overlap(self) -> int:
        """The most windows one event can fall into."""
        return -(-self.window_seconds // self.slide_seconds)

    @property
    def windows_per_day(self) -> float:
        return 86400 / self.window_seconds


DEFAULT_WINDOW = WindowSpec()
DEMO_WINDOW = WindowSpec("30 seconds", "10 seconds", "5 seconds")


@dataclass(frozen=True)
class StockPolicy:
    """Cut points of the two risk policies and the reorder buffer."""

    critical_days: float = 1
    high_days: float = 2
    medium_days: float = 4
    medium_slack_days: int = 1
    buffer_days: int = 2
    unit_price: float = KPI_UNIT_PRICE


@dataclass(frozen=True)
class ForestParams:
    """Random-forest settings; the defaults are those of the stored model."""

    trees: int = 100
    depth: int = 10
    subsampling: float = 0.8
    seed: int = 42
    test_percent: float = 20.0


COMPACT_FOREST = ForestParams(trees=50, subsampling=1.0)
