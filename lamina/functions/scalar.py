"""Scalar functions as Spark expressions: clamping, curves, dates, paths, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def cyclic(x: Column, size: int) -> Column:
    return F.pmod(x, F.lit(size))


def scaled_round(x: Column, scale: int) -> Column:
    return F.round(x * scale) / scale


def b_spline(x: Column) -> Column:
    """Cubic B-spline."""
    a = F.abs(x)
    return F.when(a < 1, 2 / 3 - a * a + a * a * a / 2).when(a < 2, (2 - a) * (2 - a) * (2 - a) / 6).otherwise(0.0)


def b_spline_derivative(x: Column) -> Column:
    a = F.abs(x)
    return F.when(a < 1, -2 * x + 1.5 * x * a).when(a < 2, -F.signum(x) * (2 - a) * (2 - a) / 2).otherwise(0.0)


def valley(x: Column, sigma: float) -> Column:
    return x * x / (x * x + sigma * sigma + 0.001)


def whole_months(a: Column, b: Column) -> Column:
    """Months from date a to b; 16 days or more of a begun month count as one."""
    months = F.floor(F.months_between(F.trunc(b, "month"), F.trunc(a, "month")))
    days = F.dayofmonth(b) - F.dayofmonth(a)
    return (months + F.when(days >= 16, 1).when(days <= -16, -1).otherwise(0)).cast("int")


def base_name(path: Column) -> Column:
    return F.substring_index(F.regexp_replace(path, r"\\", "/"), "/", -1)


def dir_name(path: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(path, r"\\", "/"), r"^(.*)/[^/]*$", 1)


def subject(name: Column) -> Column:
    """The whole number after 'sub'; empty without one."""
    return F.regexp_extract(name, r"sub-?0*(\d+)", 1)


def range_low(text: Column) -> Column:
    return F.split(text, "-")[0].cast("int")


def range_high(text: Column) -> Column:
    return F.split(text, "-")[1].cast("int")


def gaussian(x: Column, mean: float, sigma: float) -> Column:
    return F.exp(-((x - mean) ** 2) / (2 * sigma * sigma)) / (sigma * F.sqrt(F.lit(2 * 3.141592653589793)))


def separated(text: Column, by: str = ",") -> Column:
    """Runs of white space as one separator; none at either end."""
    return F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), " ", by)


def fill_in(template: Column, values: dict[str, Column]) -> Column:
    """%name% and #name# replaced by values."""
    for name, v in values.items():
        for mark in "%#":
            template = F.replace(template, F.lit(f"{mark}{name}{mark}"), v)
    return template


#: The slice of coordinate 0 along each axis of the standard brain space.
MNI_ZERO = (90, 126, 72)


def mni_to_slice(x: Column, axis: int) -> Column:
    """Whole slice of a coordinate; halves round up."""
    return F.floor(x + 0.5) + MNI_ZERO[axis]


def slice_to_mni(x: Column, axis: int) -> Column:
    return F.floor(x + 0.5) - MNI_ZERO[axis]


def run_order(name: Column) -> Column:
    """A key that sorts run names by the number after their first '_'; names without one come last, by name."""
    number = F.get(F.split(name, "_"), F.lit(1)).try_cast("long")
    return F.struct(number.isNull().alias("none"), number.alias("number"), name.alias("name"))


def running_sums(xs: Column) -> Column:
    """Cumulative sums of an array of whole numbers."""
    none = F.array().cast("array<bigint>")
    return F.aggregate(xs, none, lambda a, x: F.array_append(a, F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)) + x))


def zero_filled(xs: Column, n: int) -> Column:
    """An array of n numbers: the first ones given, then zeros."""
    return F.slice(F.concat(F.transform(xs, lambda x: F.coalesce(x.cast("double"), F.lit(0.0))), F.array_repeat(F.lit(0.0), n)), F.lit(1), F.lit(n))


def converter_date(name: Column) -> Column:
    """The first fourteen digits in a row of a converter's file name, its date and time; 'no-date' if there are none."""
    d = F.regexp_extract(name, r"(\d{14})", 1)
    return F.when(d == "", F.lit("no-date")).otherwise(d)
