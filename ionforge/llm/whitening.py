"""Embedding whitening by incremental eigendecomposition.

1. Every task keeps a spectrum: number of rows, mean, eigenvalues and
   eigenvectors of the scatter. A row is one centred rank-one update: the roots
   of the secular equation are the new eigenvalues, found all at once by
   rational interpolation between the poles inside shrinking brackets. Entries
   that the update doesn't touch and clusters of equal eigenvalues are deflated
   first; eigenvectors come from an update vector recomputed from the roots, so
   they stay orthogonal.
2. Spectra are combined ``FAN`` at a time, level by level: the smaller one's
   eigenpairs and the difference of the means are successive rank-one updates.
3. The combined basis is refined by one distributed Rayleigh-Ritz step: tasks
   sum the products of the exactly centred rows in that basis, and the
   eigenvectors of this small, nearly diagonal matrix turn the basis into the
   components.

Sums are over integers, so the mean of the whole table is exact up to its
division. What meets in a task or reaches the driver is one matrix of
dimension x dimension numbers at a time (``FAN`` of them when combined),
independent of the number of rows.

Defined results: rows whose vector is null, holds null or non-finite entries, or
is shorter than the longest such vector take no part; null ids and repeated rows are
rows like any other; entries count as at most 2^52 in size after scaling; a
component without variance (below 1e-12 of the first) has whitened values of 0
and doesn't count in ``identity_error``; a deviation beyond 38 digits is null;
an empty table gives an empty result. Only the id and the vector are read, so
other columns can't clash.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from ionforge.session import stored

COMPONENTS = 8
#: Spectra or sums combined in one step.
FAN = 16
EPS = np.finfo(float).eps
SCALE, SHIFT = 1024, 100_000
#: Share of the first eigenvalue below which a component has no variance.
FLAT = 1e-12


def secular(d, z):
    """Eigenvalues of diag(d) + z z^T and eigenvectors in its coordinates; d strictly rises, no entry of z is zero."""
    k = len(d)
    square = z * z
    row = np.arange(k)
    above = np.append(d[1:], d[-1] + square.sum())  # every root lies between its pole and the next
    gap = above - d
    # measure from the nearer pole, so that differences from it keep all digits
    half = 1 + (square / (d[None, :] - d[:, None] - gap[:, None] / 2)).sum(1)
    near = np.where((half < 0) & (row < k - 1), row + 1, row)
    low = np.where(near > row, -gap / 2, np.where(half < 0, gap / 2, 0.0))
    high = np.where(near > row, 0.0, np.where(half < 0, gap, gap / 2))
    from_near = d[None, :] - d[near][:, None]
    next_pole = above - d[near]
    left = row[None, :] <= row[:, None]
    at = (low + high) / 2
    for _ in range(80):
        gaps = from_near - at[:, None]
        part = square / gaps
        value = 1 + part.sum(1)
        done = np.abs(value) <= 16 * EPS * (1 + np.abs(part).sum(1))
        if done.all():
            break
        low, high = np.where(value < 0, at, low), np.where(value > 0, at, high)
        slopes = part / gaps
        slope = slopes.sum(1)
        slope_left = (slopes * left).sum(1)
        here, there = gaps[row, row], next_pole - at
        a = (here + there) * value - here * there * slope
        b = here * there * value
        c = value - here * slope_left - there * (slope - slope_left)
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            now = at + step
        now = np.where(done, at, np.where((now > low) & (now < high), now, (low + high) / 2))
        if (now == at).all():
            break
        at = now
    gaps = from_near - at[:, None]  # pole j less root i
    # the update vector whose exact roots these are
    below = np.where(row[:, None] < row[None, :], d[:, None] - d[None, :], above[:, None] - d[None, :])
    ratio = -gaps / below
    ratio[-1] = -gaps[-1]
    exact = np.sqrt(np.abs(ratio.prod(0))) * np.sign(z)
    vectors = (exact / gaps).T
    return d[near] + at, vectors / np.sqrt((vectors * vectors).sum(0))


def rank_one(values, basis, vector):
    """Rising eigenvalues and eigenvectors of a matrix after adding the outer product of a vector."""
    z = basis.T @ vector
    weight = z @ z
    tolerance = 8 * EPS * max(values[-1], weight)
    if weight <= tolerance * EPS:
        return values, basis
    close = np.diff(values) <= tolerance
    if close.any():  # a reflection leaves a cluster of equal eigenvalues one entry of the vector
        basis = basis.copy()
        edges = np.flatnonzero(~np.concatenate([[False], close, [False]]))
        for a, b in zip(edges[:-1], edges[1:]):
            norm = np.sqrt(z[a:b] @ z[a:b])
            if b - a > 1 and norm > 0:
                mirror = z[a:b].copy()
                mirror[-1] += np.copysign(norm, mirror[-1])
                last = -np.copysign(norm, z[b - 1])
                basis[:, a:b] -= np.outer(basis[:, a:b] @ mirror, mirror) * (2 / (mirror @ mirror))
                z[a:b] = 0
                z[b - 1] = last
    touched = np.flatnonzero(np.abs(z) * np.sqrt(weight) > tolerance)
    if not len(touched):
        return values, basis
    values, basis = values.copy(), basis.copy() if len(touched) < len(values) else basis
    if len(touched) == 1:
        values[touched] += z[touched] ** 2
    else:
        values[touched], turn = secular(values[touched], z[touched])
        if len(touched) < len(values):
            basis[:, touched] = basis[:, touched] @ turn
        else:
            basis = basis @ turn
    order = np.argsort(values, kind="stable")
    return values[order], basis[:, order]


class Spectrum:
    """Count, mean and eigendecomposition of the scatter of some rows."""

    def __init__(self, n, mean, values, basis):
        self.n, self.mean, self.values, self.basis = n, mean, values, basis

    @classmethod
    def empty(cls, size):
        return cls(0, np.zeros(size), np.zeros(size), np.eye(size))

    def add(self, x):
        off = x - self.mean
        if self.n:
            self.values, self.basis = rank_one(self.values, self.basis, off * np.sqrt(self.n / (self.n + 1)))
        self.n += 1
        self.mean = self.mean + off / self.n

    def combine(self, other):
        if other.n > self.n:
            return other.combine(self)
        n, off = self.n + other.n, other.mean - self.mean
        values, basis = rank_one(self.values, self.basis, off * np.sqrt(self.n * other.n / n)) if other.n else (self.values, self.basis)
        for value, vector in zip(other.values, other.basis.T):
            if value > 0:
                values, basis = rank_one(values, basis, vector * np.sqrt(value))
        return Spectrum(n, self.mean + off * (other.n / n) if other.n else self.mean, values, basis)


def usable(df, vector_col="embedding", id_col="vec_id"):
    """Id and vector of the rows that take part, and their dimension (0: there are none)."""
    vector = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).alias("vec_id"), vector.alias("vector"))
    fine = F.col("vector").isNotNull() & (F.size("vector") > 0) & F.forall("vector", lambda c: c.isNotNull() & (F.abs(c) < float("inf")))
    rows = rows.where(fine)
    size = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    return rows.where(F.size("vector") == size), size


def integers(column, size):
    """The scaled entries of list vectors as a matrix of integers."""
    entries = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    with np.errstate(over="ignore"):
        scaled = np.floor(SCALE * entries)
    return (np.clip(scaled, -(2.0**52), 2.0**52).astype(np.int64) + SHIFT).reshape(-1, size)


def by_task(rows, start, add, fields):
    """One row of arrays for each task that has rows: ``add`` folds every batch into a state."""
    def run(batches):
        state = None
        for batch in batches:
            if batch.num_rows:
                state = add(start() if state is None else state, batch)
        if state is not None:
            yield packed(TaskContext.get().partitionId(), state, fields)

    return rows.mapInArrow(run, schema_of(fields))


def schema_of(fields):
    return "part long, " + ", ".join(f"{name} array<{kind}>" for name, kind in fields)


def packed(part, state, fields):
    arrays = [pa.array([np.ravel(x).tolist()], pa.list_(pa.int64() if kind == "long" else pa.float64())) for x, (_, kind) in zip(state, fields)]
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), *arrays], ["part", *[name for name, _ in fields]])


def combined(parts, combine, fields, name):
    """The one state that all tasks' states make, ``FAN`` at a time through written tables; None without any."""
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        total = None
        for r in rows:
            state = [np.array(r[c], np.int64 if kind == "long" else float) for c, kind in fields]
            total = state if total is None else combine(total, state)
        return pa.Table.from_batches([packed(rows[0]["part"] // FAN, total, fields)])

    parts = stored(parts, name)
    while parts.count() > 1:
        parts = stored(parts.groupBy(F.floor(F.col("part") / FAN).alias("to")).applyInArrow(run, schema_of(fields)), name)
    row = parts.first()  # one state
    return row and [np.array(row[c], np.int64 if kind == "long" else float) for c, kind in fields]


SPECTRUM = (("n", "long"), ("sums", "long"), ("ends", "long"), ("mean", "double"), ("values", "double"), ("basis", "double"))


def spectrum_of(state, size):
    return Spectrum(int(state[0][0]), state[3], state[4], state[5].reshape(size, size))


def incremental(rows, size):
    """Rows, exact sums, smallest and largest entry, and the combined spectrum of all rows."""
    def start():
        return np.zeros(size, np.int64), np.array([2**62, -(2**62)]), Spectrum.empty(size)

    def add(state, batch):
        x = integers(batch.column("vector"), size)
        sums, ends, spectrum = state
        for row in x.astype(float):
            spectrum.add(row)
        return sums + x.sum(0), np.array([min(ends[0], x.min()), max(ends[1], x.max())]), spectrum

    def flat(state):
        sums, ends, s = state
        return [np.array([s.n]), sums, ends, s.mean, s.values, s.basis]

    def combine(a, b):
        s = spectrum_of(a, size).combine(spectrum_of(b, size))
        return [a[0] + b[0], a[1] + b[1], np.array([min(a[2][0], b[2][0]), max(a[2][1], b[2][1])]), s.mean, s.values, s.basis]

    def run(batches):
        state = None
        for batch in batches:
            if batch.num_rows:
                state = add(start() if state is None else state, batch)
        if state is not None:
            yield packed(TaskContext.get().partitionId(), flat(state), SPECTRUM)

    return combined(rows.mapInArrow(run, schema_of(SPECTRUM)), combine, SPECTRUM, "spectra")


def summed(rows, add, sizes, name):
    """Arrays of doubles summed over all rows: ``add`` gives those of a batch."""
    fields = tuple((f"s{i}", "double") for i in range(len(sizes)))
    parts = by_task(rows, lambda: [np.zeros(n) for n in sizes], lambda state, batch: [s + np.ravel(x) for s, x in zip(state, add(batch))], fields)
    return combined(parts, lambda a, b: [x + y for x, y in zip(a, b)], fields, name)


class Model:
    """Mean (as exact sums over n rows), components in columns, their eigenvalues, and the variance of all dimensions."""

    def __init__(self, n, sums, ends, components, values, trace):
        self.n, self.sums, self.ends, self.components, self.values, self.trace = n, sums, ends, components, values, trace


def fit(rows, size, components=COMPONENTS):
    """Fit the components of usable rows; None if there are none."""
    state = incremental(rows, size)
    if state is None:
        return None
    n, sums, ends = int(state[0][0]), state[1], state[2]
    basis = np.linalg.qr(spectrum_of(state, size).basis[:, ::-1])[0]
    mean = sums / n

    def products(batch):
        y = (integers(batch.column("vector"), size) - mean) @ basis
        return [y.T @ y]

    (ritz,) = summed(rows, products, [size * size], "ritz")
    ritz = ritz.reshape(size, size) / n
    values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
    top = np.argsort(values)[::-1][:components]
    return Model(n, sums, ends, basis @ turn[:, top], np.maximum(values[top], 0), float(np.trace(ritz)))


def transform(rows, size, model):
    """Id, exact deviation and the array of whitened values of every usable row."""
    fine = model.values > FLAT * max(model.values[0], 0)
    with np.errstate(divide="ignore"):
        onto = model.components * np.where(fine, 1 / np.sqrt(model.values), 0)
    n, sums, mean = model.n, model.sums, model.sums / model.n
    small = size * (n * (int(model.ends[1]) - int(model.ends[0]))) ** 2 < 2**62
    most = 10**38

    def run(batches):
        for batch in batches:
            x = integers(batch.column("vector"), size)
            white = (x - mean) @ onto
            if small:
                deviation = pa.array(((n * x - sums) ** 2).sum(1)).cast(pa.decimal128(38, 0))
            else:  # Python's integers are exact at any size
                exact = ((x.astype(object) * n - sums.astype(object)) ** 2).sum(1)
                deviation = pa.array([v if v < most else None for v in exact.tolist()], pa.decimal128(38, 0))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * white.shape[1]), pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), deviation, lists], ["vec_id", "deviation", "whitened"])

    return rows.mapInArrow(run, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, deviation decimal(38,0), whitened array<double>")


def identity_error(white, model):
    """Largest absolute entry of the whitened values' covariance minus the identity."""
    k = len(model.values)

    def products(batch):
        w = batch.column("whitened").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
        return [w.sum(0), w.T @ w]

    total, square = summed(white, products, [k, k * k], "white-sums")
    mean = total / model.n
    fine = model.values > FLAT * max(model.values[0], 0)
    off = square.reshape(k, k) / model.n - np.outer(mean, mean) - np.eye(k)
    return float(np.abs(off[np.ix_(fine, fine)]).max(initial=0.0))


def whiten(df, components=COMPONENTS, vector_col="embedding", id_col="vec_id"):
    """One row per usable vector and component: whitened value, the component's share of the variance, and the fit's figures."""
    rows, size = usable(df, vector_col, id_col)
    model = fit(rows, size, components) if size else None
    if model is None:
        white = rows.select("vec_id", F.lit(None).cast("decimal(38,0)").alias("deviation"), F.lit(None).cast("array<double>").alias("whitened")).where(F.lit(False))
        shares, n, error = [], 0, 0.0
    else:
        white = stored(transform(rows, size, model), "whitened")
        shares, n, error = [float(v / model.trace) if model.trace > 0 else 0.0 for v in model.values], model.n, identity_error(white, model)
    each = white.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.element_at(F.array(*map(F.lit, shares)).cast("array<double>"), F.col("at") + 1)
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))
