"""Points, boxes and matrices as column expressions. A matrix is an array of six doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def identity() -> Column:
    return F.array(*map(F.lit, (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)))


def translate(x, y) -> Column:
    return F.array(*map(F.lit, (1.0, 0.0, 0.0, 1.0)), F.lit(x).cast("double") if not isinstance(x, Column) else x, F.lit(y).cast("double") if not isinstance(y, Column) else y)


def transform_point(m: Column, x: Column, y: Column) -> Column:
    return F.struct((m[0] * x + m[2] * y + m[4]).alias("x"), (m[1] * x + m[3] * y + m[5]).alias("y"))


def multiply(m: Column, n: Column) -> Column:
    """The matrix that applies n first, then m."""
    return F.array(n[0] * m[0] + n[1] * m[2], n[0] * m[1] + n[1] * m[3], n[2] * m[0] + n[3] * m[2], n[2] * m[1] + n[3] * m[3], n[4] * m[0] + n[5] * m[2] + m[4], n[4] * m[1] + n[5] * m[3] + m[5])


def product(matrices: Column) -> Column:
    """Product of an array of matrices, as successive concatenations make it."""
    return F.aggregate(matrices, identity(), multiply)


def corners(m: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Transformed corners of a box: lower left, lower right, upper right, upper left."""
    return F.array(*(transform_point(m, *p) for p in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))))


def normal_box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(F.least(x0, x1).alias("x0"), F.least(y0, y1).alias("y0"), F.greatest(x0, x1).alias("x1"), F.greatest(y0, y1).alias("y1"))


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def placement_box(m: Column) -> Column:
    """Bounding box of the unit square under a placement matrix."""
    c = corners(m, F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0))
    xs, ys = F.transform(c, lambda p: p["x"]), F.transform(c, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def inline_size(width: Column, height: Column, components: Column, bits: Column) -> Column:
    """Bytes of an unfiltered inline image."""
    return (F.ceil(width * components * bits / 8) * height).cast("bigint")


#: A PDF number; casts alone accept more.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"


def pdf_number(lexeme: Column) -> Column:
    """The value of a number's text, null where the grammar does not allow it."""
    return F.when(lexeme.rlike(NUMBER), lexeme.cast("double"))


def pdf_hex(text: Column) -> Column:
    """Bytes of a hexadecimal string's digits; an odd one gets a trailing zero."""
    clean = F.regexp_replace(text, r"[\x00\t\n\f\r ]", "")
    return F.unhex(F.when(F.length(clean) % 2 == 1, F.concat(clean, F.lit("0"))).otherwise(clean))
