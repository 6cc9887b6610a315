"""Colours and contrast as column expressions. A colour is a struct r, g, b of ints."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Minimum contrast of text, and of large text.
MINIMUM, MINIMUM_LARGE = 4.5, 3.0


def parse_hex(text: Column) -> Column:
    """Six or three hex digits, with or without a number sign; else null."""
    bare = F.regexp_replace(F.trim(text), "^#", "")
    six = F.when(F.length(bare) == 3, F.regexp_replace(bare, "(.)", "$1$1")).otherwise(bare)
    part = lambda i: F.conv(F.substring(six, i, 2), 16, 10).cast("int")
    return F.when(six.rlike("^[0-9a-fA-F]{6}$"), F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b")))


def from_number(n: Column) -> Column:
    part = lambda shift: F.shiftright(n.cast("int"), shift).bitwiseAND(F.lit(255))
    return F.struct(part(16).alias("r"), part(8).alias("g"), part(0).alias("b"))


def to_hex(colour: Column) -> Column:
    return F.lpad(F.hex((colour["r"] * 65536 + colour["g"] * 256 + colour["b"]).cast("long")), 6, "0")


def luminance(colour: Column) -> Column:
    def channel(c: Column) -> Column:
        s = c / 255.0
        return F.when(s <= 0.03928, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * channel(colour["r"]) + 0.7152 * channel(colour["g"]) + 0.0722 * channel(colour["b"])


def contrast(a: Column, b: Column) -> Column:
    """At least 1; the order of the colours does not matter."""
    la, lb = luminance(a), luminance(b)
    return (F.greatest(la, lb) + 0.05) / (F.least(la, lb) + 0.05)


def minimum_ratio(points: Column, bold: Column) -> Column:
    return F.when((points >= 18) | (bold & (points >= 14)), MINIMUM_LARGE).otherwise(MINIMUM)


def format_ratio(ratio: Column) -> Column:
    """Two decimals, cut off, without trailing zeros: 4.5:1."""
    cut = F.format_string("%.2f", F.floor(ratio * 100) / 100)
    return F.concat(F.regexp_replace(cut, r"\.?0+$", ""), F.lit(":1"))


def adjusted(ink: Column, paper: Column, minimum: Column, halvings: int = 24) -> Column:
    """The ink, mixed with as little black (on light paper) or white (on dark paper) as reaches the minimum; null if a colour or the minimum is.

    The least share is searched for by halving, for a batch of rows at once. On the way to the end of the scale luminance goes one
    way, so ink that falls short has one share from which on it is enough; the mixture is taken at a share that was tried, or at
    the end, so there is nothing to go on by after rounding.
    """

    @F.arrow_udf("int")
    def mixed(inks: pa.Array, papers: pa.Array, least: pa.Array) -> pa.Array:
        parts = lambda a: np.stack([a.to_numpy(zero_copy_only=False).astype(np.int64) >> shift & 255 for shift in (16, 8, 0)])
        level = np.arange(256) / 255.0
        level = np.where(level <= 0.03928, level / 12.92, ((level + 0.055) / 1.055) ** 2.4)
        light = lambda c: 0.2126 * level[c[0]] + 0.7152 * level[c[1]] + 0.0722 * level[c[2]]
        known = pc.and_(pc.and_(inks.is_valid(), papers.is_valid()), least.is_valid())
        from_, other, wanted = parts(inks.filter(known)), light(parts(papers.filter(known))), least.filter(known).to_numpy(zero_copy_only=False)
        end = np.where(other > 0.5, 0, 255)
        enough = lambda c: (np.maximum(light(c), other) + 0.05) / (np.minimum(light(c), other) + 0.05) >= wanted
        mix = lambda share: np.floor(from_ + (end - from_) * share + 0.5).astype(np.int64)
        low, high = np.zeros(len(wanted)), np.ones(len(wanted))
        for _ in range(halvings):
            middle = (low + high) / 2
            ok = enough(mix(middle))
            low, high = np.where(ok, low, middle), np.where(ok, middle, high)
        c = np.where(enough(from_), from_, mix(high))
        return pc.replace_with_mask(pa.nulls(len(inks), pa.int32()), known, pa.array(c[0] << 16 | c[1] << 8 | c[2], pa.int32()))

    number = lambda c: c["r"] * 65536 + c["g"] * 256 + c["b"]
    found = mixed(number(ink), number(paper), minimum.cast("double"))
    return F.when(found.isNotNull(), from_number(found))
