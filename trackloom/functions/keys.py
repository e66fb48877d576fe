"""Text keys, whole milliseconds and other scalar rules shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A text of this form is its own slug, so most rows need a single match and no rewriting.
_ALREADY_A_KEY = "^[a-z0-9]+(_[a-z0-9]+)*$"


def slug(text: Column, default: str | None = None) -> Column:
    """Lower case, every run of characters outside ``a-z 0-9 _`` and every run of ``_`` as one ``_``, none at the ends.

    Null stays null; with ``default``, null and an empty result become ``default``.
    """
    runs = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_")
    key = F.when(text.rlike(_ALREADY_A_KEY), text).otherwise(F.regexp_replace(runs, "^_|_$", ""))
    return key if default is None else F.coalesce(F.nullif(key, F.lit("")), F.lit(default))


def is_outside(zone_id: Column) -> Column:
    """True where a zone id is null, empty or white space (any Unicode white space)."""
    return zone_id.isNull() | zone_id.rlike(r"^(?U)\s*$")


def zone_key(zone_id: Column) -> Column:
    """The slug of a zone id, null outside any zone."""
    return F.when(~is_outside(zone_id), slug(zone_id))


def whole_ms(seconds: Column) -> Column:
    """``round(1000 * seconds)`` as a bigint; null for null, NaN and infinite values."""
    finite = seconds.isNotNull() & ~F.isnan(seconds) & (F.abs(seconds) < F.lit(9.0e12))
    return F.when(finite, F.round(seconds * 1000).cast("bigint"))


def finite(value: Column) -> Column:
    """``value`` if it is a finite number, else null."""
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)
