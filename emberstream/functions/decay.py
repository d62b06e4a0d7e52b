"""Fading counts in closed form.

A count that fades by ``f`` per unit of time is the sum of f ** (now - t) over its hits, so it is
an ordinary aggregate; (value, time) pairs can be kept and merged later.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def fading(horizon: float) -> float:
    """The factor for one unit of time."""
    if horizon <= 0:
        raise ValueError("the time horizon must be positive")
    return math.exp(-1.0 / horizon)


def weight(now: Column, then: Column, horizon: float) -> Column:
    """What a hit at ``then`` counts at ``now``."""
    return F.exp(-(now - then) / F.lit(float(horizon)))


def age(now: Column, added: Column, horizon: float) -> Column:
    """1 - f ** (now - added); null for an observer that was just added."""
    return F.nullif(F.lit(1.0) - weight(now, added, horizon), F.lit(0.0))


def average_observations(count: Column, now: Column, touched: Column, added: Column, horizon: float) -> Column:
    """The faded count over the age, null for a new observer."""
    return count * weight(now, touched, horizon) / age(now, added, horizon)
