"""Score arithmetic, bands and number formatting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from .. import lexicon as lx
from .columns import col


#: Sums of decimal products carry binary noise around 1e-16; a nudge far above it
#: and far below the last kept digit makes ties round up whatever the summation order.
TIE_NUDGE = 1e-9
#: Numbers of a vector whose products are written out; other sizes give the same, more slowly.
WRITTEN_OUT = 64


def round4(c: Column) -> Column:
    """``c`` at four places.

    ``round`` writes a double as decimal text and reads it again; with the nudge no score lies on
    a tie, and a whole number over 10,000 is the same double.  ``+ 0.0`` takes the sign off a zero.
    """
    return F.rint((c + TIE_NUDGE) * 10_000.0) / 10_000.0 + 0.0


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def _banded(c: Column, bands: Sequence[tuple[float, str]], lowest: str) -> Column:
    out = None
    for floor, label in bands:
        test = c >= floor
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(lowest)


def score_band(c: Column | str) -> Column:
    return _banded(col(c), lx.SCORE_BANDS, lx.LOWEST_BAND)


def score_tone(c: Column | str) -> Column:
    return _banded(col(c), lx.SCORE_TONES, lx.LOWEST_TONE)


def percent_text(c: Column | str) -> Column:
    """``0.125`` -> ``12%`` (half to even)."""
    return F.concat(F.bround(col(c) * 100, 0).cast("bigint").cast("string"), F.lit("%"))


def number_text(c: Column | str) -> Column:
    """Shortest decimal text of a number with at most six significant decimals (``%g``)."""
    value = F.round(col(c), 6)
    whole = value == F.floor(value)
    return F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))


def years_text(c: Column | str) -> Column:
    return F.concat(number_text(c), F.lit(" years"))


def rescale_similarity(c: Column) -> Column:
    return clamp(c / F.lit(lx.SEMANTIC_CEILING))


def relative_lift(value: Column, base: Column) -> Column:
    return F.when(base != 0, F.round((value - base) / base, 4))


def age_band(birth_year: Column | str, as_of_year: int) -> Column:
    age = F.lit(as_of_year) - col(birth_year)
    out = None
    for low, high, label in lx.AGE_BANDS:
        test = (age >= low) & (age < high)
        out = F.when(test, label) if out is None else out.when(test, label)
    return out


def score_bucket(c: Column | str) -> Column:
    out = None
    for label, low, high in lx.SCORE_BUCKETS:
        test = (col(c) >= low) & (col(c) < high)
        out = F.when(test, label) if out is None else out.when(test, label)
    return out


def human_size(c: Column | str) -> Column:
    size = col(c).cast("double")
    kib, mib, gib = 1024.0, 1024.0**2, 1024.0**3
    return (
        F.when(size < kib, F.format_string("%.0f B", size))
        .when(size < mib, F.format_string("%.1f KB", F.bround(size / kib, 1)))
        .when(size < gib, F.format_string("%.1f MB", F.bround(size / mib, 1)))
        .otherwise(F.format_string("%.1f GB", F.bround(size / gib, 1)))
    )


def dot(a: Column, b: Column) -> Column:
    """Inner product of two vectors of one length.

    The products of a vector of ``WRITTEN_OUT`` numbers are written out and added in the order
    of the lambda: Spark compiles these and interprets a lambda, at several times the cost.
    """
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    total = F.lit(0.0)
    for i in map(F.lit, range(WRITTEN_OUT)):
        total = total + F.get(a, i).cast("double") * F.get(b, i).cast("double")
    return F.when(F.size(a) == WRITTEN_OUT, total).otherwise(
        F.aggregate(products, F.lit(0.0), lambda s, v: s + v)
    )


def norm(a: Column) -> Column:
    return F.sqrt(
        F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    )


def cosine_of(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    """Cosine of two vectors whose lengths are already known."""
    lengths = norm_a * norm_b
    usable = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (lengths > 0)
    return F.when(usable, clamp(dot(a, b) / lengths, -1.0, 1.0)).otherwise(0.0)


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine in [-1, 1]; 0 when a side is absent, shapes differ or a norm is 0."""
    return cosine_of(a, b, norm(a), norm(b))
