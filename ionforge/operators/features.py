"""The fixed 740-column reaction vector, kept sparse as two parallel arrays."""

import hashlib
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from ionforge.constants import (ATOMIC_NUMBER, ELEMENTS, FRACTION_TOLERANCE, ION_PERIOD, IONS, N_SPACEGROUPS,
                                OPTIONAL_REACTION_FIELDS, REACTION_FIELDS, SIDES, SYSTEMS)
from ionforge.functions.composition import Endpoint, evaluated_once
from ionforge.functions.values import crystal_system, finite_number, has_text, integral_number, stripped

# Order of the composition summaries and the interval columns.
SUMMARIES = ("atomic_number_mean", "atomic_number_std", "atomic_number_min", "atomic_number_max",
             "n_elements", "fraction_entropy", "fraction_l2_norm")
INTERVAL_COLUMNS = ("fracA_charge", "fracA_discharge", "delta_fracA",
                    "ion_per_host_charge", "ion_per_host_discharge", "delta_ion_per_host")
BLOCKS = ("endpoint_element_fractions", "endpoint_composition_summaries", "working_ion",
          "concentration_interval", "crystal_system", "spacegroup")
ENTRY_TYPE = "array<struct<idx:int,val:double>>"


def feature_columns():
    """(index, name, block) of every column, in vector order."""
    names = []
    names += [(f"{s}_atom_fraction_{e}", BLOCKS[0]) for s in SIDES for e in ELEMENTS]
    names += [(f"{s}_{n}", BLOCKS[1]) for s in SIDES for n in SUMMARIES]
    names += [(f"working_ion_{i}", BLOCKS[2]) for i in IONS]
    names += [("working_ion_atomic_number", BLOCKS[2]), ("working_ion_period", BLOCKS[2])]
    names += [(n, BLOCKS[3]) for n in INTERVAL_COLUMNS]
    names += [(f"{s}_crystal_system_{c}", BLOCKS[4]) for s in SIDES for c in SYSTEMS]
    names += [(f"{s}_spacegroup_{n:03d}", BLOCKS[5]) for s in SIDES for n in range(1, N_SPACEGROUPS + 1)]
    return [(i, name, block) for i, (name, block) in enumerate(names)]


WIDTH = len(feature_columns())
SCHEMA_HASH = hashlib.sha256(json.dumps(feature_columns(), separators=(",", ":")).encode()).hexdigest()
_OFFSET = {name: i for i, name, _ in feature_columns()}


def feature_schema(spark):
    return spark.createDataFrame(feature_columns(), "idx int, name string, block string")


def _literal_map(pairs):
    return F.create_map(*[F.lit(x) for pair in pairs for x in pair])


def normalize_reaction(rows):
    """Typed, trimmed reaction inputs plus ``input_error`` (null when usable)."""
    missing = [c for c in REACTION_FIELDS if c not in rows.columns]
    if missing:
        raise ValueError("missing reaction inputs: " + ", ".join(missing))
    added, errors = {}, []
    for s in SIDES:
        group, system = F.col(f"spacegroup_number_{s}").cast("string"), F.col(f"crystal_system_{s}")
        added[f"sg_{s}"] = integral_number(group).try_cast("int")
        added[f"system_{s}"] = F.lower(stripped(system))
        errors += [(F.col(f"sg_{s}").isNull(), f"spacegroup_number_{s} is not an integer"),
                   (~F.coalesce(F.length(system) > 0, F.lit(False)), f"crystal_system_{s} is empty"),
                   (~F.coalesce(F.length(f"formula_{s}") > 0, F.lit(False)), f"formula_{s} is empty")]
    for c in OPTIONAL_REACTION_FIELDS:
        text = F.col(c).cast("string") if c in rows.columns else F.lit(None).cast("string")
        added[f"given_{c}"] = finite_number(text)
        value, given = F.col(f"given_{c}"), text.isNotNull() & (text != "")
        errors.append((given & ~F.coalesce((value >= 0) & (value < 1), F.lit(False)), f"{c} is not an atom fraction"))
    error = F.coalesce(*[F.when(p, F.lit(m)) for p, m in errors])
    # numbers are read once, whatever names them afterwards
    return rows.withColumns(added).withColumn("input_error", error)


def _checked(rows):
    """Normalised reactions with what speaks against them before their formulas are read (``__before``), and whether each side's symmetry is sound."""
    rows = normalize_reaction(rows)
    unknown = ~F.coalesce(F.col("working_ion").isin(*IONS), F.lit(False))
    sound = {f"__sound_{s}": F.coalesce(crystal_system(F.col(f"sg_{s}")) == F.col(f"system_{s}"), F.lit(False)) for s in SIDES}
    return rows.withColumns({"__before": F.coalesce("input_error", F.when(unknown, "unsupported working ion")), **sound})


#: Reasons found by reading the formulas, first one first.
REASONS = [text for s in SIDES for text in (f"{s} formula is invalid or has no host", f"{s} atom fraction disagrees with its formula", f"{s} symmetry is inconsistent")]
REASONS += ["endpoint hosts differ", "loading does not increase"]


def _reactions(before: pa.Array, ion: pa.Array, charge: pa.Array, discharge: pa.Array, given_charge: pa.Array, given_discharge: pa.Array,
               sound_charge: pa.Array, sound_discharge: pa.Array, system_charge: pa.Array, system_discharge: pa.Array,
               sg_charge: pa.Array, sg_discharge: pa.Array) -> pa.Array:
    """Of each reaction: the first reason against it, loading and fraction of both sides, and its vector if there is no reason."""
    numbers = lambda a: a.cast(pa.float64()).to_numpy(zero_copy_only=False)
    ends = Endpoint(charge, ion), Endpoint(discharge, ion)
    faults = []
    for end, given, sound in zip(ends, (given_charge, given_discharge), (sound_charge, sound_discharge)):
        faults += [end.left == 0, np.abs(numbers(given) - end.fraction) > FRACTION_TOLERANCE, ~sound.to_numpy(zero_copy_only=False).astype(bool)]
    lo, hi, f_lo, f_hi = ends[0].loading, ends[1].loading, ends[0].fraction, ends[1].fraction
    faults += [ends[0].differs(ends[1]), hi <= lo]
    first = np.argmax(np.stack([*faults, np.ones(len(ion), bool)]), axis=0)
    error = pc.coalesce(before, pa.array(REASONS + [None], pa.string()).take(pa.array(first)))
    lists = _vectors(error.is_null(), *ends, ion, system_charge, system_discharge, sg_charge, sg_discharge, [f_lo, f_hi, f_hi - f_lo, lo, hi, hi - lo])
    values = [pa.array(v, from_pandas=True) for v in (lo, hi, f_lo, f_hi)]
    return pa.StructArray.from_arrays([error, *values, *lists], ["error", "loading_charge", "loading_discharge", "fraction_charge", "fraction_discharge", "idx", "val"])


def _fractions(end, usable):
    """Row, atomic number and atom fraction of every element of the usable rows, by row and atomic number, and elements per row; rows are numbered anew."""
    mine = usable[end.row]
    row, n = (np.cumsum(usable) - 1)[end.row[mine]], end.n[mine].astype(float)
    return row, end.z[mine], n / np.bincount(row, n, usable.sum())[row], end.size[usable]


def composition_summaries(row, z, f, count):
    """Weighted atomic-number and fraction summaries of one endpoint, in column order."""
    total = lambda value: np.bincount(row, value, len(count))
    mean = total(z * f)
    spread = np.where(count == 1, 0.0, np.sqrt(np.maximum(total(f * z * z) - mean * mean, 0.0)))
    last = np.cumsum(count) - 1
    return mean, spread, z[last - count + 1], z[last], count, -total(f * np.log(f)), np.sqrt(total(f * f))


_POSITION = {"ion": {e: i + _OFFSET["working_ion_Li"] for i, e in enumerate(IONS)}, "system": {e: i for i, e in enumerate(SYSTEMS)}}


def _numbers(texts, table):
    """A number per text by a small table."""
    coded = texts.dictionary_encode()
    return np.array([table[t] for t in coded.dictionary.to_pylist()])[coded.indices.to_numpy()]


def _vectors(ok, charge, discharge, ion, system_charge, system_discharge, sg_charge, sg_discharge, interval):
    """Columns and values of the non-zero entries of the reactions that are in order, block by block; null for the others."""
    usable = ok.to_numpy(zero_copy_only=False).astype(bool)
    kept = np.flatnonzero(usable)
    mine = lambda a: a.take(pa.array(kept))
    row, idx, val = [], [], []

    def add(column, value, own=None):
        row.append(np.arange(len(kept)) if own is None else own)
        idx.append(np.broadcast_to(column, row[-1].shape))
        val.append(np.broadcast_to(np.asarray(value, float), row[-1].shape))

    if len(kept):
        ends = {s: _fractions(c, usable) for s, c in zip(SIDES, (charge, discharge))}
        for s, (own, z, f, _) in ends.items():
            add(z + (_OFFSET[f"{s}_atom_fraction_H"] - 1), f, own)
        for s, found in ends.items():
            for i, v in enumerate(composition_summaries(*found)):
                add(_OFFSET[f"{s}_atomic_number_mean"] + i, v)
        ions = mine(ion)
        add(_numbers(ions, _POSITION["ion"]), 1.0)
        add(_OFFSET["working_ion_atomic_number"], _numbers(ions, ATOMIC_NUMBER))
        add(_OFFSET["working_ion_period"], _numbers(ions, ION_PERIOD))
        for i, step in enumerate(interval):
            add(_OFFSET["fracA_charge"] + i, step[kept])
        for s, c in zip(SIDES, (system_charge, system_discharge)):
            add(_numbers(mine(c), _POSITION["system"]) + _OFFSET[f"{s}_crystal_system_triclinic"], 1.0)
        for s, c in zip(SIDES, (sg_charge, sg_discharge)):
            add(mine(c).to_numpy(zero_copy_only=False) + (_OFFSET[f"{s}_spacegroup_001"] - 1), 1.0)
    row, idx, val = (np.concatenate(a) if a else np.empty(0) for a in (row, idx, val))
    there = val != 0.0
    row, idx, val = kept[row[there].astype(np.int64)], idx[there].astype(np.int32), val[there].astype(float)
    order = np.argsort(row, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(ok)))]).astype(np.int32)
    return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(a[order]), mask=pa.array(~usable)) for a in (idx, val)]


def assemble_features(rows, keep):
    """Whitelisted rows to sparse vectors ``idx``/``val``; other columns cannot reach the vector.

    Rows that fail a check keep ``reaction_error`` and get null arrays.
    """
    rows = _checked(rows.select(*dict.fromkeys(
        [*keep, *REACTION_FIELDS, *[c for c in OPTIONAL_REACTION_FIELDS if c in rows.columns]])))
    of = F.arrow_udf(_reactions, "struct<error:string,loading_charge:double,loading_discharge:double,fraction_charge:double,fraction_discharge:double,idx:array<int>,val:array<double>>")
    sides = [F.col(n.format(s)) for n in ("formula_{}", "given_fracA_{}", "__sound_{}", "system_{}", "sg_{}") for s in SIDES]
    states = evaluated_once(rows.withColumn("__x", of("__before", "working_ion", *sides)).select(*keep, "__x"), "__x")
    host = {"ion_per_host_charge": "loading_charge", "ion_per_host_discharge": "loading_discharge",
            "computed_fracA_charge": "fraction_charge", "computed_fracA_discharge": "fraction_discharge"}
    return states.select(*keep, *[F.col(f"__x.{c}").alias(n) for n, c in host.items()], F.col("__x.error").alias("reaction_error"),
                         F.col("__x.idx").alias("idx"), F.col("__x.val").alias("val"))


def long_form(features, keys):
    """One row per non-zero entry."""
    return features.select(*keys, F.inline(F.arrays_zip("idx", "val")))


def dense_to_sparse(rows, vector):
    """Dense array column to the same ``idx``/``val`` layout."""
    val = F.transform(vector, lambda v: v.cast("double"))
    return rows.withColumns({"idx": F.sequence(F.lit(0), F.size(vector) - 1), "val": val}).drop(vector)
