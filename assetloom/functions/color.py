"""Colour expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed


def luma(r: Column, g: Column, b: Column) -> Column:
    """Integer luma 0..255."""
    wr, wg, wb = fixed.LUMA_WEIGHTS
    return F.shiftright(r * wr + g * wg + b * wb, 8)


def chroma(r: Column, g: Column, b: Column) -> Column:
    """Widest distance between two channels."""
    return F.greatest(r, g, b) - F.least(r, g, b)


def packed_rgb(r: Column, g: Column, b: Column) -> Column:
    """One int per distinct colour."""
    return r * 65536 + g * 256 + b


def coarse_bin(r: Column, g: Column, b: Column) -> Column:
    """Four bits per channel: 4096 bins."""
    return F.shiftright(r, 4) * 256 + F.shiftright(g, 4) * 16 + F.shiftright(b, 4)


def bin_center(bin_: Column, channel: str) -> Column:
    """Centre of a coarse bin for one channel."""
    shift = {"r": 8, "g": 4, "b": 0}[channel]
    return F.shiftright(bin_, shift).bitwiseAND(F.lit(15)) * 16 + 8


def srgb_to_linear(c: Column) -> Column:
    """Decode a 0..1 sample to linear light."""
    return (F.when(c <= fixed.SRGB_DECODE_CUT, c / 12.92)
            .otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4))))


def linear_to_srgb(c: Column) -> Column:
    """Encode a linear 0..1 value."""
    return (F.when(c <= fixed.SRGB_ENCODE_CUT, c * 12.92)
            .otherwise(1.055 * F.pow(c, F.lit(1.0 / 2.4)) - 0.055))


def encode_sample(linear: Column, depth: int = 8) -> Column:
    """Clamp, encode and round a linear value to an integer sample."""
    top = float(2 ** depth - 1)
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), linear))
    return F.round(linear_to_srgb(clamped) * top).cast("int")


def decode_sample(sample: Column, depth: int = 8) -> Column:
    """Integer sample to linear light."""
    return srgb_to_linear(sample.cast("double") / float(2 ** depth - 1))
