"""Cost model of an order, and interpolation on a grid of quantiles."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Price of a row without one.
FALLBACK_PRICE = 3.0


@dataclass(frozen=True)
class CostModel:
    """Shares of the price: margin, what of a left unit is spoilt, and holding."""

    margin: float = 0.3
    spoilage: float = 0.6
    holding: float = 0.02

    def __post_init__(self) -> None:
        if not 0 < self.margin < 1:
            raise ValueError(f"margin must lie between 0 and 1, not {self.margin}")
        if not 0 <= self.spoilage <= 1:
            raise ValueError(f"spoilage must lie in [0, 1], not {self.spoilage}")
        if self.holding < 0:
            raise ValueError(f"holding must not be negative, not {self.holding}")

    def unit(self, price: Column) -> Column:
        return price * F.lit(1 - self.margin)

    def under(self, price: Column) -> Column:
        """Cost of a unit too few."""
        return price * F.lit(self.margin)

    def over(self, price: Column) -> Column:
        """Cost of a unit too many."""
        return self.unit(price) * F.lit(self.spoilage + self.holding)

    def critical_ratio(self) -> float:
        """The price cancels: it is the same for every row."""
        cu, co = self.margin, (1 - self.margin) * (self.spoilage + self.holding)
        return cu / (cu + co) if cu + co else 0.5


def grid_with(levels: Sequence[float], ratio: float) -> tuple[float, ...]:
    """The grid with the ratio itself in it, at four places."""
    return tuple(sorted({*levels, round(float(ratio), 4)}))


def nearest(levels: Sequence[float], target: float) -> int:
    """The place of the level nearest to ``target``; of two, the first."""
    return min(range(len(levels)), key=lambda i: (abs(levels[i] - target), i))


def bracket(levels: Sequence[float], target: float) -> tuple[int, float]:
    """The place of the level at or below ``target``, and how far it is towards the next; outside the grid there is none, an error."""
    if not levels[0] <= target <= levels[-1]:
        raise ValueError(f"{target} lies outside the grid {levels[0]} to {levels[-1]}")
    k = next(i for i, q in enumerate(levels) if q >= target)
    return (k, 0.0) if levels[k] == target else (k - 1, (target - levels[k - 1]) / (levels[k] - levels[k - 1]))


def interpolate(levels: Sequence[float], values: Sequence[Column], target: float) -> Column:
    """Linear interpolation between the two levels round ``target``; outside the grid there is no answer, and that is an error."""
    k, w = bracket(levels, target)
    return values[k] + F.lit(w) * (values[k + 1] - values[k]) if w else values[k]


def bin_masses(levels: Sequence[float]) -> list[float]:
    """Probability that each grid point stands for: from midpoint to midpoint."""
    edges = [0.0, *((a + b) / 2 for a, b in zip(levels[:-1], levels[1:], strict=True)), 1.0]
    return [b - a for a, b in zip(edges[:-1], edges[1:], strict=True)]


def expected_cost(levels: Sequence[float], values: Sequence[Column], quantity: Column, under: Column, over: Column) -> Column:
    """Sum over the grid of mass times the cost of being short or left."""
    zero = F.lit(0.0)
    parts = [F.lit(p) * (F.greatest(v - quantity, zero) * under + F.greatest(quantity - v, zero) * over) for p, v in zip(bin_masses(levels), values, strict=True)]
    return sum(parts[1:], parts[0])
