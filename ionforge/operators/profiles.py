"""Voltage profiles: states to intervals, contiguity rules, plotting geometry.

Neighbours are the next rows of a profile in the order of positions, which may
have gaps. A profile has at most MAX_INTERVALS intervals by contract, so a window
over one is short.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ionforge.operators.skew import attach
from ionforge.rules import flags

# Plot frame and margins of the profile drawing.
FRAME = {"width": 720.0, "height": 340.0, "left": 64.0, "right": 24.0, "top": 26.0, "bottom": 63.0}
MIN_INTERVALS, MAX_INTERVALS = 2, 50


def states_to_intervals(states, profile="profile_id", position="pos", fields=("formula", "spacegroup_number")):
    """Consecutive state pairs: one interval from every state that has a next one."""
    order = Window.partitionBy(profile).orderBy(position)
    keep = [c for c in states.columns if c not in fields]
    pairs = states.select(*keep, *[F.col(f).alias(f"{f}_charge") for f in fields],
                          *[F.lead(f).over(order).alias(f"{f}_discharge") for f in fields],
                          F.lead(F.lit(True), 1, False).over(order).alias("__next"))
    return pairs.where("__next").drop("__next")


def _close(a, b, rel, absolute):
    return F.abs(a - b) <= F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def profile_contiguity(intervals, profile="profile_id", position="pos", same=("working_ion", "model_family", "training_population", "host"),
                       symmetry=("spacegroup_number", "crystal_system"), tolerance=1e-9):
    """Violation codes per interval: shared choices and host, no gap, matching shared symmetry, 2 to 50 intervals."""
    first = intervals.groupBy(profile).agg(
        F.count(F.lit(1)).alias("n"), F.min_by(F.struct(*same), position).alias("__first"))
    rows = attach(intervals, first.withColumn("__n", F.col("n")), [profile], ["__first", "__n"], [position])
    order = Window.partitionBy(profile).orderBy(position)
    shared = F.struct(*[F.col(f"{c}_discharge").alias(c) for c in symmetry])
    rows = rows.withColumns({"__end": F.lag("end").over(order), "__sym": F.lag(shared).over(order), "__has": F.lag(F.lit(True)).over(order)})
    has = F.coalesce("__has", F.lit(False))
    own = F.struct(*[F.col(f"{c}_charge").alias(c) for c in symmetry])
    rules = [(f"different_{c}", ~F.col(c).eqNullSafe(F.col(f"__first.{c}"))) for c in same]
    rules += [("gap_or_overlap", has & ~F.coalesce(_close(F.col("start"), F.col("__end"), tolerance, tolerance), F.lit(False))),
              ("shared_symmetry_differs", has & ~F.col("__sym").eqNullSafe(own)),
              ("interval_count", ~F.col("__n").between(MIN_INTERVALS, MAX_INTERVALS))]
    return rows.withColumn("violations", flags(rules)).drop("__first", "__n", "__end", "__sym", "__has")


def profile_scales(steps, profile="profile_id", start="start", end="end", value="value"):
    """x range and padded y range per profile."""
    lo, hi = F.min(value), F.max(value)
    pad = F.greatest((hi - lo) * 0.15, F.abs(hi) * 0.02, F.lit(0.1))
    return steps.groupBy(profile).agg(F.count(F.lit(1)).alias("n"), F.min(start).alias("x_min"), F.max(end).alias("x_max"),
                                      (lo - pad).alias("y_min"), (hi + pad).alias("y_max"))


def _x(v):
    f = FRAME
    return f["left"] + F.try_divide(v - F.col("x_min"), F.col("x_max") - F.col("x_min")) * (f["width"] - f["left"] - f["right"])


def _y(v):
    f = FRAME
    return (f["height"] - f["bottom"]) - (v - F.col("y_min")) / (F.col("y_max") - F.col("y_min")) * (f["height"] - f["top"] - f["bottom"])


def profile_steps(steps, profile="profile_id", position="pos", start="start", end="end", value="value"):
    """Scaled horizontal segment of every interval; a profile of zero width has null x positions."""
    scales = profile_scales(steps, profile, start, end, value)
    rows = attach(steps, scales, [profile], ["x_min", "x_max", "y_min", "y_max"], [position])
    return rows.select(profile, position, _x(F.col(start)).alias("x1"), _x(F.col(end)).alias("x2"), _y(F.col(value)).alias("y"))


def profile_ticks(steps, profile="profile_id", start="start", end="end", value="value"):
    """Six x ticks and five y ticks per profile."""
    scales = profile_scales(steps, profile, start, end, value)
    axis = lambda name, n, lo, hi, at: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(
        F.lit(name).alias("axis"), i.alias("tick"), (lo + (hi - lo) * i / (n - 1)).alias("tick_value"),
        at(lo + (hi - lo) * i / (n - 1)).alias("pixel")))
    ticks = F.concat(axis("x", 6, F.col("x_min"), F.col("x_max"), _x), axis("y", 5, F.col("y_min"), F.col("y_max"), _y))
    return scales.select(profile, F.inline(ticks))
