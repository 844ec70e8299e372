"""Arithmetic at printed precision: a literal stands for the interval of what rounds to it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9
# Two-sided 95% critical values of Student's t for 1 to 30 degrees of freedom; 1.96 beyond.
T95 = [12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042]


def parsed(raw: Column) -> Column:
    """A printed number as a double; U+2212 is a minus, commas go."""
    return F.translate(raw, "−,", "-").try_cast("double")


def decimals(raw: Column) -> Column:
    """Digits printed after the point, exponents aside."""
    return F.length(F.regexp_extract(raw, r"^[^eE]*?\.(\d+)", 1))


def exponent(raw: Column) -> Column:
    """The printed exponent, 0 where there is none; an empty text is not cast, since each failed cast makes an exception."""
    return F.coalesce(F.nullif(F.regexp_extract(raw, r"[eE]([-+]?\d+)", 1), F.lit("")).try_cast("int"), F.lit(0))


def half_width(raw: Column) -> Column:
    """Half a unit of the last printed place."""
    return 0.5 * F.pow(F.lit(10.0), (exponent(raw) - decimals(raw)).cast("double"))


def tolerance(raw: Column) -> Column:
    """What a value may differ from a printed number and still round to it."""
    return half_width(raw) * 1.0001 + EPS


def around(v: Column, h: Column) -> Column:
    return F.struct((v - h).alias("lo"), (v + h).alias("hi"))


def interval(raw: Column) -> Column:
    return around(parsed(raw), half_width(raw))


def magnitude(iv: Column) -> Column:
    """The interval of absolute values."""
    lo, hi = iv["lo"], iv["hi"]
    return F.struct(F.when(lo >= 0, lo).when(hi <= 0, -hi).otherwise(0.0).alias("lo"), F.greatest(F.abs(lo), F.abs(hi)).alias("hi"))


def difference(a: Column, b: Column) -> Column:
    """Magnitudes that a - b may have."""
    return magnitude(F.struct((a["lo"] - b["hi"]).alias("lo"), (a["hi"] - b["lo"]).alias("hi")))


def relative_change(base: Column, other: Column) -> Column:
    """Per cent by which other may differ from base; null where base may be zero."""
    corners = [100 * F.abs(o - b) / F.abs(b) for b in (base["lo"], base["hi"]) for o in (other["lo"], other["hi"])]
    safe = ~((base["lo"] <= 0) & (base["hi"] >= 0))
    return F.when(safe, F.struct(F.least(*corners).alias("lo"), F.greatest(*corners).alias("hi")))


def overlap(a: Column, b: Column) -> Column:
    return (a["lo"] - EPS <= b["hi"]) & (b["lo"] - EPS <= a["hi"])


def significant_digits(raw: Column) -> Column:
    """Printed significant digits: trailing zeros count only after a point."""
    digits = F.regexp_replace(F.regexp_replace(F.substring_index(raw, "e", 1), r"\D", ""), "^0+", "")
    return F.when(F.contains(raw, F.lit(".")), F.length(digits)).otherwise(F.greatest(F.length(F.regexp_replace(digits, "0+$", "")), F.lit(1)))


def evidence_needed(raw: Column) -> Column:
    """Less specific numbers match by chance more often, so they need more words in common."""
    n = significant_digits(raw)
    return F.when(n >= 4, 2).when(n == 3, 3).otherwise(4)


def student_t(df: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, T95)), df.cast("int") - 1), F.lit(1.96))


def shown(x: Column) -> Column:
    """A number for a message: twelve decimals at most, no exponent, no trailing zeros."""
    plain = F.regexp_replace(x.cast("double").try_cast("decimal(38,12)").cast("string"), r"\.0+$|(\.\d*?[1-9])0+$", "$1")
    return F.when((x != 0) & (plain.isin("0", "-0")), F.format_string("%.4g", x.cast("double"))).otherwise(F.coalesce(plain, x.cast("string")))
