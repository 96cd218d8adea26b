"""Fold-scoped masks, scalers and PCA from one pass of sufficient statistics.

Statistics are kept per fold; the training side of fold f is "all folds but
f", obtained by subtraction (sums) or by combining the other folds (min/max).
``fold = -1`` names the fit on every development row.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ionforge.constants import CONSTANT_TOLERANCE, SUPPORT_TOLERANCE
from ionforge.functions.keys import set_digest
from ionforge.operators.sparse import column, dense, entries
from ionforge.session import stored

ALL = -1


class _Moments:
    """Rows, and by column the number, mean, squares about the mean, least and greatest of the entries that one fold's rows have."""

    def __init__(self, width):
        self.rows, self.n, self.mean, self.squares = 0, np.zeros(width), np.zeros(width), np.zeros(width)
        self.low, self.high = np.full(width, np.inf), np.full(width, -np.inf)

    def add(self, rows, col, value):
        """Take in the entries of some rows; means and squares are joined without cancellation (Chan et al. 1979)."""
        width = len(self.n)
        n = np.bincount(col, minlength=width).astype(float)
        mean = np.bincount(col, value, width) / np.maximum(n, 1)
        squares = np.bincount(col, (value - mean[col]) ** 2, width)
        total, apart = np.maximum(self.n + n, 1), mean - self.mean
        self.squares += squares + apart * apart * (self.n * n / total)
        self.mean += apart * (n / total)
        self.n += n
        self.rows += rows
        np.minimum.at(self.low, col, value)
        np.maximum.at(self.high, col, value)


def column_moments(features, width):
    """Per (fold, column, task): entries ``nnz``, their mean ``m``, squares ``sq`` about it, min and max; column -1 has the rows. One pass."""
    def run(batches):
        found = {}
        for batch in batches:
            folds, (row, col, value) = column(batch, "fold"), entries(batch)
            for f in np.unique(folds):
                own = folds == f
                mine = own[row]
                found.setdefault(int(f), _Moments(width)).add(int(own.sum()), col[mine], value[mine])
        for f, m in found.items():
            at = np.flatnonzero(m.n)
            put = lambda first, a: pa.array(np.concatenate([[first], a[at]]))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(at) + 1, f)), pa.array(np.concatenate([[-1], at]).astype(np.int32)), put(m.rows, m.n).cast(pa.int64()),
                put(0.0, m.mean), put(0.0, m.squares), put(0.0, m.low), put(0.0, m.high)], ["fold", "idx", "nnz", "m", "sq", "lo", "hi"])

    rows = features.where(F.col("fold").isNotNull()).select(F.col("fold").cast("long").alias("fold"), "idx", "val")
    return rows.mapInArrow(run, "fold long, idx int, nnz long, m double, sq double, lo double, hi double")


def _other_scopes(folds):
    """All scopes a row of column ``fold`` trains for: every other fold, and the full fit."""
    return F.filter(F.array(*[F.lit(s) for s in (*range(folds), ALL)]), lambda s: s != F.col("fold"))


def fit_states(features, width, folds):
    """State table, one row per (training scope, column): n, mask, mean, population std, constant value.

    ``features`` holds ``fold``, ``idx``, ``val`` for the development rows of
    one population, read in one pass; ``folds`` is the number of folds.  The
    pass leaves folds * width rows a task, every other intermediate has at
    most that many in all.  Squares are taken about the overall mean, which
    keeps total-minus-fold free of cancellation.
    """
    spark = features.sparkSession
    parts = stored(column_moments(features, width), "moments")
    rows = parts.where("idx = -1").groupBy("fold").agg(F.sum("nnz").alias("rows"))
    parts = parts.where("idx >= 0")
    columns = spark.range(width).select(F.col("id").cast("int").alias("idx"))
    overall = parts.groupBy("idx").agg(F.sum(F.col("nnz") * F.col("m")).alias("t1"))
    n_all = rows.agg(F.sum("rows")).scalar()
    center = columns.join(overall, "idx", "left").select("idx", (F.coalesce("t1", F.lit(0.0)) / n_all).alias("center"))
    off = F.col("m") - F.col("center")
    moments = parts.join(F.broadcast(center), "idx").groupBy("fold", "idx").agg(
        F.sum("nnz").alias("nnz"), F.sum(F.col("nnz") * off).alias("d1"), F.sum(F.col("sq") + F.col("nnz") * off * off).alias("d2"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    # A dense (fold, column) grid of bounded size: folds x width rows.
    grid = rows.withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    zero_gap = F.col("rows") - F.coalesce("nnz", F.lit(0))
    per_fold = (grid.join(moments, ["fold", "idx"], "left").join(F.broadcast(center), "idx")
                .select("fold", "idx", "rows", "center",
                        (F.coalesce("d1", F.lit(0.0)) - zero_gap * F.col("center")).alias("d1"),
                        (F.coalesce("d2", F.lit(0.0)) + zero_gap * F.col("center") * F.col("center")).alias("d2"),
                        F.when(zero_gap > 0, F.least(F.coalesce("lo", F.lit(0.0)), F.lit(0.0))).otherwise(F.col("lo")).alias("lo"),
                        F.when(zero_gap > 0, F.greatest(F.coalesce("hi", F.lit(0.0)), F.lit(0.0))).otherwise(F.col("hi")).alias("hi")))
    # Training side of every scope: each fold's statistics serve all scopes but its own.
    targets = per_fold.withColumn("scope", F.explode(_other_scopes(folds)))
    n, d1, d2 = F.sum("rows"), F.sum("d1"), F.sum("d2")
    var = F.greatest(d2 / n - (d1 / n) * (d1 / n), F.lit(0.0))
    return targets.groupBy("scope", "idx").agg(
        n.alias("train_rows"), (F.max("hi") - F.min("lo") > CONSTANT_TOLERANCE).alias("active"),
        (F.first("center") + d1 / n).alias("mean"), F.sqrt(var).alias("std"))


def varying_mask(states):
    return states.where("active").select("scope", "idx")


def scaler_arrays(states):
    """Active columns, means and deviations by scope (scopes x width numbers)."""
    out = {}
    for s, g in states.where("active").select("scope", "idx", "mean", "std").toPandas().groupby("scope"):
        g = g.sort_values("idx")
        out[int(s)] = (g["idx"].to_numpy(), g["mean"].to_numpy(), g["std"].to_numpy())
    return out


def _by_scope_blocks(rows, keys, scope, width, out, represent):
    """One row per input row: its keys and scope, and the list that ``represent(block, scope)`` makes of it."""
    names = [*keys, scope]
    kept = rows.select(*names, "idx", "val")
    schema = T.StructType([*kept.drop("idx", "val").schema.fields, *[T.StructField(n, t) for n, t in out]])

    def run(batches):
        for batch in batches:
            x, scopes = dense(batch, width), column(batch, scope)
            for s in np.unique(scopes):
                at = np.flatnonzero(scopes == s)
                lists = []
                for block in represent(x[at], int(s)):
                    offsets = np.arange(len(at) + 1, dtype=np.int32) * block.shape[1]
                    lists.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(block.ravel())))
                own = [batch.column(n).take(pa.array(at)) for n in names]
                yield pa.RecordBatch.from_arrays([*own, *lists], schema.names)

    return kept.mapInArrow(run, schema)


def scaled_vectors(rows, states, keys, width, scope="scope"):
    """The active columns of each row's scope and their (x - mean) / std, one row per input row.

    ``states`` has at most scopes * width rows, which bounds what the tasks receive.
    """
    shared = rows.sparkSession.sparkContext.broadcast(scaler_arrays(states))

    def represent(x, s):
        idx, mean, std = shared.value[s]
        return np.broadcast_to(idx.astype(np.int32), (len(x), len(idx))), (x[:, idx] - mean) / std

    out = (("idx", T.ArrayType(T.IntegerType())), ("scaled", T.ArrayType(T.DoubleType())))
    return _by_scope_blocks(rows, keys, scope, width, out, represent)


def transform_scaled(rows, states, keys, width, scope="scope"):
    """Long form of ``scaled_vectors``: one row per row and active column."""
    wide = scaled_vectors(rows, states, keys, width, scope)
    return wide.select(*keys, scope, F.inline(F.arrays_zip("idx", "scaled")))


class _Fixed:
    """Columns that are constant in training, with their constants: which entries differ, and which constants a row lacks."""

    def __init__(self, idx, constant):
        width = int(idx.max(initial=-1)) + 1
        self.constant = np.full(width, np.nan)
        self.constant[idx] = constant
        self.set = idx[np.abs(constant) > SUPPORT_TOLERANCE]

    def differing(self, size, row, col, value):
        """Row and column of what differs in ``size`` rows; columns beyond the known ones aren't judged."""
        known = col < len(self.constant)
        row, col, value = row[known], col[known], value[known]
        other = ~(np.abs(value - self.constant[col]) <= SUPPORT_TOLERANCE) & ~np.isnan(self.constant[col])
        there = np.zeros((size, len(self.set)), bool)
        place = np.full(len(self.constant), -1)
        place[self.set] = np.arange(len(self.set))
        held = place[col] >= 0
        there[row[held], place[col][held]] = True
        gone, which = np.nonzero(~there)
        return np.concatenate([row[other], gone]), np.concatenate([col[other], self.set[which]])


def _fixed(states, key):
    """``_Fixed`` by scope or population (at most that many times width rows)."""
    out = {}
    table = states.select(key, "idx", "mean", "active").toPandas()
    for k, g in table.groupby(key):
        g = g[~g["active"].astype(bool)].sort_values("idx")
        out[k] = _Fixed(g["idx"].to_numpy().astype(int), g["mean"].to_numpy())
    return out


def support_diagnostics(rows, states, keys, scope="scope"):
    """Columns constant in training whose value differs in a row: one row per (row, column)."""
    shared = rows.sparkSession.sparkContext.broadcast(_fixed(states, "scope"))
    kept = rows.select(*keys, F.col(scope).alias("__scope"), "idx", "val")
    schema = T.StructType([*kept.select(*keys).schema.fields, T.StructField("idx", T.IntegerType())])

    def run(batches):
        for batch in batches:
            scopes, (row, col, value) = column(batch, "__scope"), entries(batch)
            for s, fixed in shared.value.items():
                own = np.flatnonzero(scopes == s)
                if len(own):
                    at = np.full(len(scopes), -1)
                    at[own] = np.arange(len(own))
                    mine = at[row] >= 0
                    r, c = fixed.differing(len(own), at[row[mine]], col[mine], value[mine])
                    yield pa.RecordBatch.from_arrays([*[batch.column(k).take(pa.array(own[r])) for k in keys], pa.array(c, pa.int32())], schema.names)

    return kept.mapInArrow(run, schema)


def population_states(states):
    """Full-fit states of several populations (``{name: states}``) in one table with a ``population`` column."""
    out = None
    for name, table in states.items():
        part = table.where(F.col("scope") == ALL).withColumn("population", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def changed_counts(rows, states, out="changed_constants"):
    """Add how many columns that are constant in the training of a row's population differ in the row.

    Only a row's own entries are visited, an Arrow batch at a time: each is
    compared with its column's constant, found by position, and constants other
    than zero without an entry are counted by what is missing.
    """
    shared = rows.sparkSession.sparkContext.broadcast(_fixed(states, "population"))

    def count(population: pa.Array, vector: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays(vector.flatten(), ["idx", "val"])
        (row, col, value), own = entries(batch), population.to_numpy(zero_copy_only=False)
        found = np.zeros(len(own), np.int32)
        for name, fixed in shared.value.items():
            mine = own == name
            hit, _ = fixed.differing(len(own), row, col, value)
            found += np.where(mine, np.bincount(hit, minlength=len(own)), 0).astype(np.int32)
        return pa.array(found)

    return rows.withColumn(out, F.arrow_udf(count, "int")("population", F.struct("idx", "val")))


#: Entries of a packed matrix in one shuffled row, and partial matrices added up in one task.
BLOCK, FAN = 32_768, 16


def block_sums(parts):
    """Sum blocks (``fold, block, part, vec``) over their parts, ``FAN`` at a time, so that no task sees all of them."""
    def add(table: pa.Table) -> pa.Table:
        vec = table.column("vec").combine_chunks()
        total = vec.flatten().to_numpy(zero_copy_only=False).reshape(len(vec), -1).sum(0)
        first = table.slice(0, 1)
        part = pa.array([first.column("part")[0].as_py() // FAN], pa.int64())
        return pa.Table.from_arrays([first.column("fold"), first.column("block"), part, pa.array([total.tolist()], pa.list_(pa.float64()))], ["fold", "block", "part", "vec"])

    levels = 1
    most = parts.agg(F.max("part")).first()[0] or 0
    while FAN**levels <= most:
        levels += 1
    for _ in range(levels):
        parts = parts.groupBy("fold", "block", F.floor(F.col("part") / FAN).alias("to")).applyInArrow(add, "fold int, block int, part long, vec array<double>")
    return parts


def fold_gram(features, width, center):
    """Per fold: the Gram matrix of the centred rows as packed upper triangles, ``{fold: matrix}``.

    Each task adds up its own rows, so what is shuffled is width x (width + 1) / 2
    numbers per (task, fold), 2.2 MB for 740 columns, in blocks of 256 kB; one
    matrix per fold reaches the driver.
    """
    mu = np.asarray(center, dtype=float)
    upper = np.triu_indices(width)

    def partial(batches):
        grams, task = {}, TaskContext.get().partitionId()
        for batch in batches:
            x, folds = dense(batch, width) - mu, column(batch, "fold")
            for f in np.unique(folds):
                block = x[folds == f]
                grams[int(f)] = grams.get(int(f), 0) + block.T @ block
        for f, g in grams.items():
            packed = g[upper]
            for b, at in enumerate(range(0, len(packed), BLOCK)):
                piece = packed[at : at + BLOCK]
                lists = pa.ListArray.from_arrays(pa.array([0, len(piece)], pa.int32()), pa.array(piece))
                yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([b], pa.int32()), pa.array([task], pa.int64()), lists], ["fold", "block", "part", "vec"])

    parts = features.select("fold", "idx", "val").mapInArrow(partial, "fold int, block int, part long, vec array<double>")
    sums = block_sums(stored(parts, "grams")).toPandas()
    out = {}
    for f, g in sums.groupby("fold"):
        square = np.zeros((width, width))
        square[upper] = np.concatenate(g.sort_values("block")["vec"].to_numpy())
        out[int(f)] = square + np.triu(square, 1).T
    return out


def fit_pca(features, states, width, components):
    """Full-rank PCA of the standardized columns for every training scope.

    The Gram matrices are built on the executors; only the folds x width x
    width sums (a size fixed by the feature schema) reach the driver, where
    one symmetric eigenproblem is solved per scope. ``squares`` is the sum of all
    squared eigenvalues, that is of all squared correlations.
    """
    rows = states.select("scope", "idx", "train_rows", "active", "mean", "std").toPandas()
    overall = rows[rows.scope == ALL].sort_values("idx")
    by_fold = fold_gram(features, width, overall["mean"].to_numpy())
    total = sum(by_fold.values())
    out = []
    for scope, state in rows.groupby("scope"):
        state = state.sort_values("idx")
        n, active = int(state["train_rows"].iloc[0]), state["active"].to_numpy()
        if min(n - 1, int(active.sum())) < components:
            raise ValueError("not enough training rows or varying columns for the requested PCA size")
        shift = state["mean"].to_numpy() - overall["mean"].to_numpy()
        cov = (total - by_fold.get(scope, 0)) / n - np.outer(shift, shift)
        std = state["std"].to_numpy()[active]
        corr = cov[np.ix_(active, active)] / np.outer(std, std)
        values, vectors = np.linalg.eigh((corr + corr.T) / 2)
        order = np.argsort(values)[::-1][:components]
        vectors = vectors[:, order]
        # Sign convention: the largest loading of a component is positive.
        vectors *= np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(components)])
        idx = state["idx"].to_numpy()[active]
        for j in range(components):
            out.append((int(scope), j, float(values[order[j]]), float(values[order[j]] / values.sum()), float(values @ values),
                        [int(i) for i in idx], [float(v) for v in vectors[:, j]]))
    schema = "scope int, component int, eigenvalue double, ratio double, squares double, idx array<int>, loading array<double>"
    return features.sparkSession.createDataFrame(out, schema)


def explained_variance(pca):
    return pca.select("scope", "component", "ratio",
                      F.sum("ratio").over(_by_scope()).alias("cumulative"))


def _by_scope():
    from pyspark.sql import Window
    # At most ``components`` rows per scope.
    return Window.partitionBy("scope").orderBy("component").rowsBetween(Window.unboundedPreceding, 0)


def transform_pca(rows, states, pca, keys, width, scope="scope"):
    """Project rows with their scope's scaler and components (matrix products per Arrow batch)."""
    model = scaler_arrays(states)
    for s, g in pca.toPandas().groupby("scope"):
        model[int(s)] += (np.stack(g.sort_values("component")["loading"].to_numpy()),)
    shared = rows.sparkSession.sparkContext.broadcast(model)  # scopes x components x width doubles

    def project(x, s):
        idx, mean, std, components = shared.value[s]
        z = ((x[:, idx] - mean) / std) @ components.T
        if not np.isfinite(z).all():
            raise ValueError("projection produced non-finite output")
        return (z,)

    return _by_scope_blocks(rows, keys, scope, width, (("pca", T.ArrayType(T.DoubleType())),), project)


def training_digests(rows, folds, uid="row_uid"):
    """Per training scope: row count and the order-free digest of its row ids."""
    per_fold = rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), set_digest(F.col(uid)).alias("d"))
    parts = per_fold.withColumn("s", F.split_part("d", F.lit(":"), F.lit(2)).cast("decimal(38,0)"))
    return (parts.withColumn("scope", F.explode(_other_scopes(folds))).groupBy("scope")
            .agg(F.sum("n").alias("train_rows"),
                 F.concat(F.sum("n").cast("string"), F.lit(":"), F.sum("s").cast("decimal(38,0)").cast("string")).alias("row_digest")))


def scope_guard(claimed, rows, folds, group="group_id"):
    """Compare claimed training digests with the rows at hand; also reports groups that span folds."""
    actual = training_digests(rows, folds).select("scope", F.col("row_digest").alias("__actual"))
    spans = rows.groupBy(group).agg((F.min("fold") != F.max("fold")).alias("bad")).agg(F.count_if("bad")).scalar()
    return (claimed.join(actual, "scope", "left").withColumn("overlap_groups", spans)
            .withColumn("valid", F.col("row_digest").eqNullSafe(F.col("__actual")) & (F.col("overlap_groups") == 0)).drop("__actual"))


def scope_claims(rows, folds, population, feature_digest):
    """What fits of a population's scopes may claim: population, scope, rows, their digest, and that of the feature schema."""
    return training_digests(rows, folds).select(
        F.lit(population).alias("population"), "scope", "train_rows", "row_digest", F.lit(feature_digest).alias("feature_digest"))


def scope_audit(claimed, actual):
    """Status of every claimed or existing (population, scope): ok, unclaimed, unknown_scope, other_features or other_rows."""
    keys = ["population", "scope"]
    mine = actual.select(*keys, "train_rows", F.struct("row_digest", "feature_digest").alias("have"))
    theirs = claimed.select(*keys, F.struct("row_digest", "feature_digest").alias("want"))
    status = (F.when(F.col("want").isNull(), "unclaimed").when(F.col("have").isNull(), "unknown_scope")
              .when(~F.col("want.feature_digest").eqNullSafe(F.col("have.feature_digest")), "other_features")
              .when(~F.col("want.row_digest").eqNullSafe(F.col("have.row_digest")), "other_rows").otherwise("ok"))
    return mine.join(theirs, keys, "full_outer").select(*keys, "train_rows", status.alias("status"))


def assert_scopes(audit):
    """Turn an audit of scopes into an error on the first that isn't ok."""
    return audit.withColumn("verdict", F.when(F.col("status") != "ok", F.raise_error(F.concat_ws(" ", F.lit("scope refused:"), "population", F.col("scope").cast("string"), "status"))).otherwise("ok"))


def materialize_fold(rows, folds):
    """Rows repeated per scope with their side: validation in their own fold, training elsewhere.

    Row count is folds x rows by definition; filter ``scope`` to get one fold.
    """
    return rows.withColumn("scope", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).withColumn(
        "side", F.when(F.col("scope") == F.col("fold"), "validation").otherwise("training"))
