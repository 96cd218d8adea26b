"""Scalar column expressions: numbers, text, symbols, bucket lookups."""

from pyspark.sql import functions as F

from ionforge.constants import CRYSTAL_SYSTEMS, IONS

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"


def stripped(col):
    # printable ASCII has no white space but blanks
    return F.when(col.rlike("[^ -~]"), F.regexp_replace(col, r"^\s+|\s+$", "")).otherwise(F.trim(col))


def has_text(col):
    return F.coalesce(col.rlike(r"\S"), F.lit(False))


def is_finite(col):
    inf = float("inf")
    return F.coalesce(~F.isnan(col) & (F.abs(col) < inf), F.lit(False))


def _if(value, test):
    """A value where a test of it holds, else null; the value is evaluated once, however often the test names it."""
    return F.get(F.filter(F.array(value), test), F.lit(0))


def finite_number(col):
    """Text to a finite double, anything else to null."""
    # what isn't a number as a whole becomes empty, and that null
    number = F.regexp_extract(stripped(col), NUMBER, 0).try_cast("double")
    return _if(number, lambda v: F.abs(v) < float("inf"))


def finite_or_null(col):
    """Typed double column with non-finite values nulled."""
    return F.when(is_finite(col), col)


def is_digits(col):
    return F.coalesce(col.rlike("^[0-9]+$"), F.lit(False))


def bucket_lookup(col, bounds, low=1):
    """Name of the first bucket whose upper bound covers the value, else null."""
    out = None
    for upper, name in bounds:
        hit = (col >= low) & (col <= upper)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def crystal_system(col):
    return bucket_lookup(col, CRYSTAL_SYSTEMS)


def normalize_symbol(col, allowed=IONS):
    """Symbol from plain text or a JSON object with element/symbol/value."""
    is_object = col.rlike(r"^\s*\{")
    choice = [F.when(col.isin(*allowed), col)]
    for field in ("element", "symbol", "value"):
        inner = F.get_json_object(F.when(is_object, col), f"$.{field}")
        choice.append(F.when(inner.isin(*allowed), inner))
    return F.coalesce(*choice)


def integral_number(col):
    """Text such as ``62`` or ``62.0`` to an integer, else null."""
    return _if(finite_number(col), lambda v: (F.abs(v) < 1e15) & (v == F.floor(v))).cast("bigint")
