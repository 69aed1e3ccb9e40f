"""Scalar functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_rank(*parts) -> Column:
    """A value in [0, 1) that depends on nothing but the parts: CRC-32 of their text, joined by |."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.crc32(F.encode(F.concat_ws("|", *[c.cast("string") for c in columns]), "UTF-8")) / F.lit(4294967296.0)


def hash_side(fraction: float, *parts) -> Column:
    """dev or test, by stable rank."""
    return F.when(stable_rank(*parts) < fraction, "dev").otherwise("test")


def machine_of(recording: Column) -> Column:
    """The recording without the suffix that numbers the columns of one machine."""
    return F.regexp_replace(recording, r"_col_\d+$", "")


def dataset_of(series_id: Column) -> Column:
    return F.split(series_id, "__")[1]


def sample_part(series_id: Column) -> Column:
    """full, chunk{N} or clean{N}: the last part of a series id."""
    return F.regexp_extract(series_id, r"_(full|chunk\d+|clean\d+)$", 1)


def notes(*parts: Column) -> Column:
    """The parts that say something, joined by semicolons."""
    return F.concat_ws(";", *[F.nullif(p, F.lit("")) for p in parts])


def clip(x: Column, low, high) -> Column:
    bound = lambda b: b if isinstance(b, Column) else F.lit(b)
    return F.least(F.greatest(x, bound(low)), bound(high))


def up_to_multiple(x: Column, step: Column) -> Column:
    return F.ceil(x / step) * step


def down_to_multiple(x: Column, step: Column) -> Column:
    return F.floor(x / step) * step


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def fraction_of_cycle(x: Column) -> Column:
    return F.pmod(x, F.lit(1.0))


def log_uniform(u: Column, low: float, high: float) -> Column:
    """A draw whose logarithm is uniform, from a uniform u."""
    return F.exp(F.log(F.lit(low)) + u * (F.log(F.lit(high)) - F.log(F.lit(low))))


def percent(x: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", x * 100)


def thousands(x: Column) -> Column:
    """A whole number with commas."""
    return F.format_number(x, 0)


def numbered(i: Column, width: int = 5) -> Column:
    return F.format_string(f"%0{width}d", i)


def is_whole(notes: Column) -> Column:
    """Whether the notes of a sample say that it is a whole series."""
    return F.coalesce(notes, F.lit("")).contains("whole_series")


def round_binary(x: Column, digits: int) -> Column:
    """Rounded by the exact binary value, ties to the even digit. Scaled values must stay below 2^52; larger ones stay as they are.

    The product with 10^digits is split into its double and the rest that this drops, by halves of both factors.
    """
    scale = 10.0**digits
    halves = lambda v: (v * 134217729.0) - ((v * 134217729.0) - v)  # noqa: E731  2^27 + 1 halves the 53 bits
    xh, sh = halves(x), 134217729.0 * scale - (134217729.0 * scale - scale)
    xl, sl = x - xh, scale - sh
    p = x * scale
    dropped = ((xh * sh - p) + xh * sl + xl * sh) + xl * sl
    low = F.floor(p).cast("double")
    over = (p - low - 0.5) + dropped
    up = (over > 0) | ((over == 0) & (low % 2 != 0))
    return F.when(F.abs(p) < 2.0**52, (low + up.cast("double")) / scale).otherwise(x)


def taper(i: Column, duration: Column, ramp: Column) -> Column:
    """The trapezoid at index i of a window that is zero at both ends."""
    slope = clip(ramp, 1, F.greatest(F.lit(1), F.floor(duration / 2)))
    return F.least(i, duration - 1 - i, slope) / slope


def number_or_null(x: Column) -> Column:
    """Cast to double; what is no number, NaN included, is null."""
    v = x.try_cast("double")
    return F.when(F.isnan(v), None).otherwise(v)


def binary_label(x: Column) -> Column:
    return (F.coalesce(x.try_cast("double"), F.lit(0.0)) > 0).cast("tinyint")
