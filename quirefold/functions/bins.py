"""Area bins, ramps and other numeric ladders."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def bin_edges(bins: int) -> list[float]:
    """Edges of equal bins over [0, 1], as multiples of the step (so 0.3 of ten bins is 0.30000000000000004)."""
    step = 1.0 / bins
    return [i * step for i in range(bins)] + [1.0]


def bin_index(share: Column, bins: int = 10, side: str = "right") -> Column:
    """The bin of a share in [0, 1]. right: an edge opens its bin, and 1 is in the last one. left: an
    edge closes the bin before it. Values outside fall into the outer bins; null stays null."""
    edges = bin_edges(bins)
    out = F.when(share.isNull(), F.lit(None).cast("int"))
    for i in range(bins - 1, 0, -1):
        out = out.when(share >= F.lit(edges[i]) if side == "right" else share > F.lit(edges[i]), F.lit(i))
    return out.otherwise(F.lit(0))


def bin_label(i: Column, bins: int = 10) -> Column:
    """'10-20%' with as many decimals as the number of bins asks for."""
    digits = max(0, math.ceil(math.log10(bins)) - 1)
    text = lambda x: F.format_string(f"%.{digits}f", x.cast("double") * 100 / bins)
    return F.concat(text(i), F.lit("-"), text(i + 1), F.lit("%"))


def linear_ramp(i: Column, start_value: float, end_value: float, start_iter: int, end_iter: int) -> Column:
    part = (i - start_iter) / float(end_iter - start_iter)
    mixed = start_value * (1 - part) + end_value * part
    return F.when(i < start_iter, F.lit(float(start_value))).when(i >= end_iter, F.lit(float(end_value))).otherwise(mixed)


def ladder_ramp(i: Column, starts: list[int], values: list[float]) -> Column:
    """values[k] where k starts are at or below i; one value more than starts."""
    assert len(values) == len(starts) + 1
    out = F.when(i < starts[0], F.lit(float(values[0]))) if starts else F.when(F.lit(True), F.lit(float(values[0])))
    for s, x in zip(starts[1:], values[1:-1], strict=True):
        out = out.when(i < s, F.lit(float(x)))
    return out.otherwise(F.lit(float(values[-1])))


def percent(done: Column, total: Column) -> Column:
    """round(100 * done / total), half to even, within 0 to 100; 0 without a total."""
    value = F.bround(100.0 * done / F.when(total > 0, total), 0)
    return F.coalesce(F.least(F.greatest(value, F.lit(0.0)), F.lit(100.0)), F.lit(0.0)).cast("int")
