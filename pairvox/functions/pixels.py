"""Pixel arithmetic on columns of values, and on arrays through `each`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: CT window, MR ceiling, backgrounds, body threshold (HU).
CT_WINDOW, MR_MAX, BACKGROUND, BODY_HU = (-1024.0, 1200.0), 2000.0, {"CT": -1024.0, "MR": 0.0, "mask": 0.0}, -400.0


def each(px: Column, f: Callable[[Column], Column]) -> Column:
    return F.transform(px, f)


def clip(v: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), v))


def window_scale(v: Column, lo: float = CT_WINDOW[0], hi: float = CT_WINDOW[1]) -> Column:
    return (clip(v, lo, hi) - lo) / (hi - lo)


def max_scale(v: Column, hi: float = MR_MAX) -> Column:
    return clip(v, 0.0, hi) / hi


def by_modality(name: Column, v: Column) -> Column:
    """A mask is left as it is, CT is windowed, MR scaled, anything else left."""
    low = F.lower(name)
    return F.when(low.contains("mask"), v).when(low.contains("ct"), window_scale(v)).when(low.contains("mr"), max_scale(v)).otherwise(v)


def unit_to_hu(v: Column, *, signed: bool = False, lo: float = CT_WINDOW[0], hi: float = CT_WINDOW[1]) -> Column:
    """[0, 1] or [-1, 1] to whole HU, cut towards zero."""
    unit = (v + 1) / 2 if signed else v
    return clip(unit * (hi - lo) + lo, lo, hi).cast("int")


def mask_fill(v: Column, m: Column, background: float) -> Column:
    return F.when(m, v).otherwise(F.lit(background))


def clip01(v: Column) -> Column:
    return clip(v, 0.0, 1.0)


def quantize_u8(v: Column, *, rounded: bool = False) -> Column:
    scaled = clip01(v) * 255
    return (F.rint(scaled) if rounded else scaled).cast("int")


def threshold_mask(v: Column, t: float = BODY_HU) -> Column:
    return (v > t).cast("int")


def finite(v: Column) -> Column:
    """Null for NaN and both infinities."""
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
