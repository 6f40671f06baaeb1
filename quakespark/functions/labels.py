"""Interval labels and record keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number_label(x: Column) -> Column:
    """A number with six significant digits and no trailing zeros, as C's %g prints those from 1e-4 to 1e6."""
    whole = F.floor(F.log10(F.greatest(F.abs(x), F.lit(1e-300)))).cast("int") + 1
    scaled = F.when(x == 0, F.lit(0.0)).otherwise(F.round(x / F.pow(F.lit(10.0), whole - 6)) * F.pow(F.lit(10.0), whole - 6))
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", scaled), r"0+$", ""), r"\.$", "")


def interval_label(low: Column, high: Column) -> Column:
    """``lo-hikm``, or ``>=lokm`` where there is no upper end."""
    return F.when(high.isNull() | (high == float("inf")), F.concat(F.lit(">="), number_label(low), F.lit("km"))).otherwise(F.concat(number_label(low), F.lit("-"), number_label(high), F.lit("km")))


def record_id(mainshock: Column, kind: Column, name: Column) -> Column:
    return F.concat_ws("|", mainshock, kind, name)


_RANGE = r"^\s*([0-9]+(?:\.[0-9]+)?)\s*-\s*([0-9]+(?:\.[0-9]+)?)\s*km\s*$"


def range_of(label: Column) -> tuple[Column, Column]:
    """(low, high) of a ``lo-hikm`` label; null where it is none."""
    part = lambda k: F.regexp_extract(label, _RANGE, k).try_cast("double")
    return part(1), part(2)


def midpoint(label: Column) -> Column:
    """The middle of an interval label; of ``>=xkm`` x; of anything else 0."""
    low, high = range_of(label)
    return F.coalesce((low + high) / 2, F.regexp_extract(label, r"^\s*>=\s*([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double"), F.lit(0.0))


def depth_group(depth: Column, bins: list[float]) -> Column:
    """``[lo, hi)`` bins; below the first or from the last on it is ``>=last``; null is unknown."""
    out = F.when(depth.isNull(), F.lit("unknown"))
    for low, high in zip(bins, bins[1:], strict=False):
        out = out.when((depth >= low) & (depth < high), F.lit(f"{low:g}-{high:g}km"))
    return out.otherwise(F.lit(f">={bins[-1]:g}km"))
