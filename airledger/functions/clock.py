"""Functions of the clock: circular distances, slots, profiles of activity, harmonics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hours of the traffic slots.
SLOTS = (0, 6, 12, 18)


def circular_hours(hour: Column, center: float) -> Column:
    d = F.abs(hour - F.lit(float(center)))
    return F.least(d, 24.0 - d)


def slot(hour: Column) -> Column:
    """Nearest traffic slot on the 24 h circle, ties to the first."""
    best, gap = F.lit(SLOTS[0]), circular_hours(hour, SLOTS[0])
    for s in SLOTS[1:]:
        d = circular_hours(hour, s)
        best, gap = F.when(d < gap, F.lit(s)).otherwise(best), F.least(d, gap)
    return best


def block12(t_idx: Column) -> Column:
    """Alternating 12-hour blocks by position; true in the first."""
    return F.pmod(F.floor(t_idx / 12), F.lit(2)) == 0


#: Hours of the cooking peaks and their width; levels and length in hours of the kilns' blocks.
PEAKS, WIDTH = (7, 13, 19), 1.25
KILN_LEVELS, KILN_BLOCK = (0.25, 0.60), 12


def phase(seed: int = 0) -> int:
    """Hours by which the kilns' blocks of a seed are moved on (0 to 3)."""
    return int(np.random.default_rng(seed).integers(0, 4))


def activity(source: Column, t_idx: Column, hour: Column, seed: int = 0, industry_24h: float = 0.25) -> Column:
    """Default activity of a source by its name; 0 for a name that is none of these.

    ``traffic_HH``: 1 in the hours nearest to slot HH. ``industries``: 1 from 7 to 19 h
    (both included), else ``industry_24h`` of them goes on and the rest falls to 0.35.
    ``population_density``: 0.2 and 0.8 at the cooking peaks, at most 1. ``brick_kilns``:
    0.60 and 0.25 in blocks of 12 hours by position.
    """
    if not 0 <= industry_24h <= 1:
        raise ValueError("industry_24h must lie between 0 and 1")
    traffic = F.when(F.regexp_extract(source, r"_(\d+)$", 1).try_cast("int") == slot(hour), 1.0).otherwise(0.0)
    industry = F.when((hour >= 7) & (hour <= 19), 1.0).otherwise(industry_24h + (1 - industry_24h) * 0.35)
    cooking = F.lit(0.2)
    for peak in PEAKS:
        d = circular_hours(hour, peak) / WIDTH
        cooking = cooking + 0.8 * F.exp(-0.5 * d * d)
    kilns = F.when(F.pmod(F.floor((t_idx + phase(seed)) / KILN_BLOCK), F.lit(2)) == 0, KILN_LEVELS[1]).otherwise(KILN_LEVELS[0])
    return (
        F.when(source.startswith("traffic_"), traffic).when(source == "industries", industry)
        .when(source == "population_density", F.least(cooking, F.lit(1.0))).when(source == "brick_kilns", kilns).otherwise(0.0)
    )


def harmonic(hour: Column, order: int) -> tuple[Column, Column]:
    """Sine and cosine of the local clock, ``order`` cycles a day."""
    angle = 2 * F.pi() * order * hour / 24.0
    return F.sin(angle), F.cos(angle)
