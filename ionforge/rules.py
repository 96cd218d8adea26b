"""Declarative row rules: one list of (code, predicate) pairs, one projection."""

from functools import reduce

from pyspark.sql import functions as F


def flags(rules):
    """Array of the codes whose predicate is true, in rule order.

    ``rules`` holds ``(code, predicate)``; a code may be a string or a Column.
    """
    fired = [F.when(p, c if not isinstance(c, str) else F.lit(c)) for c, p in rules]
    return F.array_compact(F.array(*fired))


def join_flags(*arrays):
    return F.concat(*arrays)


def canonical_flags(*arrays):
    """Sorted, unique union of flag arrays."""
    return F.sort_array(F.array_distinct(F.concat(*arrays)))


def any_of(*predicates):
    return reduce(lambda a, b: a | b, predicates)


def flag_text(array, separator=";"):
    return F.array_join(array, separator)
