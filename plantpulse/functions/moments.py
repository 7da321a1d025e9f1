"""Mergeable running moments of a value against time, as column expressions.

A state holds count, mean, centred squares, extremes and the centred products with time. States of neighbouring
stretches merge exactly, so a frame can be put together from two running windows instead of being summed row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

LEVEL = ["n", "mean", "m2", "low", "high"]
TREND = ["t", "tt", "tv"]


def state(value: Column, minute: Column, window: WindowSpec | None, trend: bool) -> Column:
    """State over a window that grows one row at a time, or of a group."""
    over = (lambda c: c) if window is None else (lambda c: c.over(window))
    n = over(F.count(value))
    zero = F.lit(0.0)
    parts = {
        "n": n.cast("double"), "mean": F.coalesce(over(F.avg(value)), zero),
        "m2": F.coalesce(over(F.var_pop(value)), zero) * n, "low": over(F.min(value)), "high": over(F.max(value)),
    }
    if trend:
        at = F.when(value.isNotNull(), minute)
        parts |= {
            "t": F.coalesce(over(F.avg(at)), zero), "tt": F.coalesce(over(F.var_pop(at)), zero) * n,
            "tv": F.coalesce(over(F.covar_pop(value, at)), zero) * n,
        }
    return F.struct(*[c.alias(k) for k, c in parts.items()])


def summed(state: Column, rows: WindowSpec, every: WindowSpec, trend: bool) -> Column:
    """The states of ``rows`` as one, as sums around the mean of ``every`` row of the partition, which keeps them small."""
    zero = F.lit(0.0)
    n = F.sum(state["n"]).over(rows)
    some = F.nullif(n, zero)

    def centre(part: str) -> Column:
        return F.coalesce(F.sum(state["n"] * state[part]).over(every) / F.nullif(F.sum(state["n"]).over(every), zero), zero)

    def moved(part: str) -> Column:
        return F.sum(state["n"] * (state[part] - centre(part))).over(rows)

    def pooled(centred: str, left: str, right: str) -> Column:
        whole = F.sum(state[centred] + state["n"] * (state[left] - centre(left)) * (state[right] - centre(right))).over(rows)
        return F.coalesce(whole - moved(left) * moved(right) / some, zero)

    parts = {
        "n": F.coalesce(n, zero), "mean": F.coalesce(centre("mean") + moved("mean") / some, zero),
        "m2": F.greatest(pooled("m2", "mean", "mean"), zero), "low": F.min(state["low"]).over(rows), "high": F.max(state["high"]).over(rows),
    }
    if trend:
        parts |= {"t": F.coalesce(centre("t") + moved("t") / some, zero), "tt": F.greatest(pooled("tt", "t", "t"), zero), "tv": pooled("tv", "mean", "t")}
    return F.struct(*[c.alias(k) for k, c in parts.items()])


def merged(a: Column, b: Column, trend: bool) -> Column:
    """Two states as one; a null state is none."""
    n = a["n"] + b["n"]
    both = a["n"] * b["n"] / F.nullif(n, F.lit(0.0))

    def mean(part: str) -> Column:
        return F.coalesce((a[part] * a["n"] + b[part] * b["n"]) / F.nullif(n, F.lit(0.0)), F.lit(0.0))

    def pooled(centred: str, left: str, right: str) -> Column:
        return a[centred] + b[centred] + F.coalesce((b[left] - a[left]) * (b[right] - a[right]) * both, F.lit(0.0))

    parts = {"n": n, "mean": mean("mean"), "m2": pooled("m2", "mean", "mean"), "low": F.least(a["low"], b["low"]), "high": F.greatest(a["high"], b["high"])}
    if trend:
        parts |= {"t": mean("t"), "tt": pooled("tt", "t", "t"), "tv": pooled("tv", "t", "mean")}
    whole = F.struct(*[c.alias(k) for k, c in parts.items()])
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(whole)


class Frame:
    """A frame made of an earlier stretch (used only where ``joined``) and a later one."""

    def __init__(self, earlier: Column, later: Column, joined: Column) -> None:
        self.a, self.b, self.joined = earlier, later, joined
        self.n1 = F.when(joined, earlier["n"]).otherwise(F.lit(0.0))
        self.n2 = later["n"]
        self.n = self.n1 + self.n2
        self.both = self.n1 * self.n2 / F.nullif(self.n, F.lit(0.0))
        self.low = F.least(F.when(joined, earlier["low"]), later["low"])
        self.high = F.greatest(F.when(joined, earlier["high"]), later["high"])
        self.flat = self.low == self.high

    def _pooled(self, centred: str, left: str, right: str) -> Column:
        apart = (self.b[left] - self.a[left]) * (self.b[right] - self.a[right]) * self.both
        own = self.b[centred] + F.when(self.joined, self.a[centred]).otherwise(F.lit(0.0))
        return own + F.when(self.n1 * self.n2 > 0, apart).otherwise(F.lit(0.0))

    def mean(self, wider: Frame | None = None) -> Column:
        """A frame of equal values has exactly that mean; a frame that holds all of a wider one has the wider one's mean."""
        weighted = (F.when(self.joined, self.a["mean"]).otherwise(F.lit(0.0)) * self.n1 + self.b["mean"] * self.n2) / F.nullif(self.n, F.lit(0.0))
        own = F.when(self.flat, self.low).otherwise(weighted)
        return own if wider is None else F.when(self.n == wider.n, wider.mean()).otherwise(own)

    def std(self) -> Column:
        """Sample deviation, NULL below two values, exactly zero for equal values."""
        spread = F.sqrt(F.greatest(self._pooled("m2", "mean", "mean"), F.lit(0.0)) / F.nullif(self.n - 1, F.lit(0.0)))
        return F.when(self.n >= 2, F.when(self.flat, F.lit(0.0)).otherwise(spread))

    def slope(self) -> Column:
        """Least-squares slope per minute from at least three values."""
        steep = self._pooled("tv", "t", "mean") / F.nullif(self._pooled("tt", "t", "t"), F.lit(0.0))
        return F.when(self.n >= 3, F.when(self.flat, F.lit(0.0)).otherwise(steep))
