"""Regressors whose training state is a fixed-size sum over rows.

Kernel models use random Fourier features (Rahimi and Recht 2007): executors
add up features x features normal equations per training scope, and only
those sums, whose size does not depend on the row count, reach the driver.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ionforge.operators.preprocess import FAN, _other_scopes
from ionforge.operators.sparse import column, entries
from ionforge.operators.trees import TreeSettings
from ionforge.session import finer, stored

# The predeclared candidate settings per family.
CANDIDATE_SETTINGS = (
    ("svr", ({"C": 10.0, "gamma": 0.1, "epsilon": 0.1}, {"C": 10.0, "gamma": "scale", "epsilon": 0.1},
             {"C": 100.0, "gamma": "scale", "epsilon": 0.1})),
    ("krr", ({"alpha": 0.01, "gamma": 0.1}, {"alpha": 0.01, "gamma": "scale"}, {"alpha": 1.0, "gamma": "scale"})),
)
REPRESENTATIONS = ("pca", "scaled")
#: Settings of the third family, boosted trees: they read the features as they are.
TREE_SETTINGS = ({"trees": 10, "depth": 4}, {"trees": 10, "depth": 3})


def candidates():
    """The search grid as plain records with stable ids."""
    kernels = [{"id": f"{family}_{rep}_{i}", "family": family, "representation": rep, "parameters": dict(p)}
               for rep in REPRESENTATIONS for family, grid in CANDIDATE_SETTINGS for i, p in enumerate(grid)]
    trees = [{"id": f"tree_raw_{i}", "family": "tree", "representation": "raw", "parameters": dict(p)} for i, p in enumerate(TREE_SETTINGS)]
    return kernels + trees


def tree_settings(candidate):
    return TreeSettings(**candidate["parameters"])


def candidate_grid(folds_in_use):
    """One task per candidate and (population, fold) actually present."""
    entries = F.array(*[F.struct(F.lit(c["id"]).alias("candidate"), F.lit(c["family"]).alias("family"),
                                 F.lit(c["representation"]).alias("representation")) for c in candidates()])
    return folds_in_use.select("*", F.inline(entries))


def gamma_scale(rows, scope, width):
    """1 / (columns * variance over all entries), or 1 for a constant matrix; ``width`` counts zeros too."""
    value = F.explode("val").alias("v")
    sums = rows.select(*scope, value).groupBy(*scope).agg(F.sum("v").alias("s1"), F.sum(F.col("v") * F.col("v")).alias("s2"))
    n = rows.groupBy(*scope).agg(F.count(F.lit(1)).alias("n"))
    cells = F.col("n") * F.lit(width)
    var = F.col("s2") / cells - (F.col("s1") / cells) * (F.col("s1") / cells)
    return n.join(sums, list(scope)).select(*scope, F.when(var > 0, 1.0 / (F.lit(width) * var)).otherwise(1.0).alias("gamma"))


def _scope_sums(rows, folds, *columns):
    """Per scope: rows ``n``, mean of every column and centred products ``a_b``, from one row of sums per fold.

    Products are taken about the overall means, so adding folds up doesn't cancel.
    """
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    rows = rows.where(F.col(columns[-1]).isNotNull())
    centre = {c: rows.agg(F.avg(c)).scalar() for c in columns}
    products = [(F.covar_pop(a, b) * F.count(F.lit(1))).alias(f"{a}_{b}") for a, b in pairs]
    per_fold = rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in columns], *products)
    moved = per_fold.select("fold", "n", *[(F.col(c) - centre[c]).alias(c) for c in columns], *[f"{a}_{b}" for a, b in pairs], *[centre[c].alias(f"__{c}") for c in columns])
    sums = moved.withColumn("scope", F.explode(_other_scopes(folds))).groupBy("scope").agg(
        F.sum("n").alias("n"), *[F.first(f"__{c}").alias(f"__{c}") for c in columns], *[(F.sum(F.col("n") * F.col(c)) / F.sum("n")).alias(c) for c in columns],
        *[F.sum(F.col(f"{a}_{b}") + F.col("n") * F.col(a) * F.col(b)).alias(f"{a}_{b}") for a, b in pairs])
    return sums.select("scope", "n", *[(F.col(c) + F.col(f"__{c}")).alias(c) for c in columns],
                       *[(F.col(f"{a}_{b}") - F.col("n") * F.col(a) * F.col(b)).alias(f"{a}_{b}") for a, b in pairs])


def target_transform(rows, folds, y="y"):
    """Training mean and population std of the target per scope (std below 1e-12 becomes 1)."""
    sums = _scope_sums(rows.select("fold", F.col(y).alias("y")), folds, "y")
    std = F.sqrt(F.greatest(F.col("y_y") / F.col("n"), F.lit(0.0)))
    return sums.select("scope", F.col("y").alias("offset"), F.when(std < 1e-12, 1.0).otherwise(std).alias("scale"))


def inverse_target(pred, offset, scale):
    return pred * scale + offset


def linear_ridge(rows, folds, x, y, alpha):
    """One-feature ridge per scope in closed form from centred sums."""
    sums = _scope_sums(rows.select("fold", F.col(x).alias("x"), F.col(y).alias("y")), folds, "x", "y")
    slope = F.col("x_y") / (F.col("x_x") + F.lit(alpha))
    return sums.select("scope", slope.alias("slope"), (F.col("y") - slope * F.col("x")).alias("intercept"))


#: Rows whose features a task makes at a time, and how many listed entries a row may have on average before all columns are dense.
CHUNK, LISTED = 2_048, 32


class Entries:
    """The non-zeros of a block of rows by row, column and value, row by row."""

    def __init__(self, size, row, column, value):
        self.size, self.row, self.column, self.value = size, row, column, value

    @classmethod
    def of(cls, x):
        if isinstance(x, cls):
            return x
        row, column = np.nonzero(x)
        return cls(len(x), row, column, x[row, column])

    def take(self, mask):
        """The rows of a mask."""
        kept = mask[self.row]
        return Entries(int(mask.sum()), (np.cumsum(mask) - 1)[self.row[kept]], self.column[kept], self.value[kept])

    def dense(self, width):
        """The rows as one block of ``width`` columns."""
        out = np.zeros((self.size, width))
        out[self.row, self.column] = self.value
        return out

    def frequent(self, width, share=0.02):
        """Columns with entries in more than a share of the rows: a column of a matrix product takes a fiftieth of a listed entry's time."""
        return np.bincount(self.column, minlength=width) > share * self.size

    def split(self, dense, width):
        """The columns ``dense`` as one array, and the entries of the others, each row's first ones, second ones and so on."""
        at = np.full(width, -1)
        at[dense] = np.arange(len(dense))
        place = at[self.column]
        inside = place >= 0
        block = np.zeros((self.size, len(dense)))
        block[self.row[inside], place[inside]] = self.value[inside]
        row, column, value = self.row[~inside], self.column[~inside], self.value[~inside]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        order = np.argsort(rank, kind="stable")
        ends = np.cumsum(np.bincount(rank)) if len(rank) else np.empty(0, int)
        parts = np.split(order, ends[:-1]) if len(ends) else []
        return block, [(row[o], column[o], value[o]) for o in parts]


def _sine_series():
    """Coefficients of sin(2 pi v) / v in v squared for up to a quarter turn; off by less than 1e-14."""
    v = 0.25 * np.cos(np.pi * (np.arange(200) + 0.5) / 400)
    return np.polynomial.Chebyshev.fit(v * v, np.sin(2 * np.pi * v) / v, 7, domain=[0, 0.0625]).convert(kind=np.polynomial.Polynomial).coef


SINE, PIECE = _sine_series(), 16_384


def cosines(turns, scale=1.0):
    """Replace angles, in whole turns, by their cosines times ``scale``, a piece at a time; half the time of ``np.cos`` for doubles."""
    flat, square, total, series = turns.reshape(-1), np.empty(PIECE), np.empty(PIECE), (SINE * scale).tolist()
    for at in range(0, flat.size, PIECE):
        u = flat[at : at + PIECE]
        q, t = square[: len(u)], total[: len(u)]
        np.rint(u, out=t)
        u -= t
        np.abs(u, out=u)
        np.subtract(0.25, u, out=u)
        np.multiply(u, u, out=q)
        np.multiply(q, series[-1], out=t)
        t += series[-2]
        for c in series[-3::-1]:
            t *= q
            t += c
        u *= t


class RandomFeatures:
    """cos(sqrt(2 gamma) z W + b) features of a represented row; picklable and seeded.

    Rows are multiplied by their entries: columns that many rows of a block have, or
    whose mean exceeds their deviation in a scope (taking the mean off afterwards would
    cancel), as one small dense array, the rest entry by entry.
    """

    def __init__(self, states, pca, gammas, size, seed, width):
        self.size, self.seed, self.width, self.gammas = size, seed, width, gammas
        self.scaler, self.pca, self._directions = {}, {}, {}
        self.centred = np.zeros(width, bool)
        for s, g in states.where("active").select("scope", "idx", "mean", "std").toPandas().groupby("scope"):
            g = g.sort_values("idx")
            idx, mean, std = g["idx"].to_numpy(), g["mean"].to_numpy(), g["std"].to_numpy()
            self.scaler[int(s)] = (idx, mean, std)
            self.centred[idx[np.abs(mean) > std]] = True
        if pca is not None:
            for s, g in pca.toPandas().groupby("scope"):
                g = g.sort_values("component")
                self.pca[int(s)] = (np.stack(g["loading"].to_numpy()).T, float(g["eigenvalue"].sum()))

    def __getstate__(self):
        return {**self.__dict__, "_directions": {}}

    def resolve(self, gamma, scope, representation):
        if gamma != "scale":
            return float(gamma)
        # Standardized columns have variance 1; projected ones have the kept eigenvalues.
        return 1.0 / (self.pca[scope][1] if representation == "pca" else len(self.scaler[scope][0]))

    def columns(self, scope, representation):
        """How many columns a representation has."""
        return self.pca[scope][0].shape[1] if representation == "pca" else len(self.scaler[scope][0])

    def directions(self, scope, representations):
        """Means (of all columns), the random directions by column, representation after representation, and what the means of columns that aren't centred give; they don't depend on gamma."""
        key = scope, representations
        if key not in self._directions:
            idx, mean, std = self.scaler[scope]
            turned, means = np.zeros((self.width, self.size * len(representations))), np.zeros(self.width)
            for i, rep in enumerate(representations):
                count = self.columns(scope, rep)
                w = np.random.default_rng([self.seed, count]).standard_normal((count, self.size))
                turned[idx, i * self.size : (i + 1) * self.size] = (self.pca[scope][0] @ w if rep == "pca" else w) / std[:, None]
            means[idx] = mean
            self._directions[key] = means, turned, means[~self.centred] @ turned[~self.centred]
        return self._directions[key]

    def wave(self, projected, columns, gamma):
        b = np.random.default_rng([self.seed, columns, 1]).uniform(0, 2 * np.pi, self.size)
        out = projected * (np.sqrt(2.0 * gamma) / (2 * np.pi))
        out += b / (2 * np.pi)
        cosines(out, np.sqrt(2.0 / self.size))
        return out

    def features(self, x, scope, representation, gamma):
        return self.many(x, scope, [(representation, gamma)])[representation, gamma]

    def many(self, x, scope, specs):
        """Features of a block (dense or ``Entries``) for several (representation, gamma), all of them projected at once."""
        x, out = Entries.of(x), {}
        frequent = self.centred | x.frequent(self.width)
        if np.sum(~frequent[x.column]) > LISTED * x.size:
            frequent[:] = True
        dense = np.flatnonzero(frequent)
        block, listed = x.split(dense, self.width)
        reps = tuple(sorted({r for r, _ in specs}))
        means, turned, taken = self.directions(scope, reps)
        own = turned[dense]
        projected = (block - means[dense]) @ own
        plain = ~self.centred[dense]
        projected -= taken - means[dense[plain]] @ own[plain]
        for row, column, value in listed:
            part = turned.take(column, axis=0)
            if (value != 1.0).any():
                part *= value[:, None]
            if len(row) == x.size:  # the first entries of all rows
                projected += part
            else:
                projected[row] += part
        for i, rep in enumerate(reps):
            mine = projected[:, i * self.size : (i + 1) * self.size]
            for r, gamma in specs:
                if r == rep:
                    out[r, gamma] = self.wave(mine, self.columns(scope, rep), self.resolve(gamma, scope, rep))
        return out


def array_sums(rows, columns, add):
    """Sums of named flat arrays over all rows: each task adds up its own, and two groupings the tasks' arrays.

    ``add`` yields (name, array) for the ``Entries`` of some rows and their other
    columns. The number of names times entries doesn't depend on the rows.
    """
    def run(batches):
        sums, task = {}, TaskContext.get().partitionId()
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                for name, array in add(Entries(part.num_rows, *entries(part)), {c: column(part, c) for c in columns}):
                    sums[name] = sums[name] + array if name in sums else array
        for name, array in sums.items():
            flat = np.ravel(array).astype(float)
            vec = pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([task % FAN], pa.int32()), vec], ["name", "part", "vec"])

    def total(table: pa.Table) -> pa.Table:
        vec = table.column("vec").combine_chunks()
        flat = vec.flatten().to_numpy(zero_copy_only=False).reshape(len(vec), -1).sum(0)
        lists = pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), pa.array(flat))
        return pa.Table.from_arrays([table.column("name").slice(0, 1), table.column("part").slice(0, 1), lists], ["name", "part", "vec"])

    schema = "name string, part int, vec array<double>"
    parts = rows.select(*columns, "idx", "val").mapInArrow(run, schema)
    for keys in (["name", "part"], ["name"]):
        parts = parts.groupBy(*keys).applyInArrow(total, schema)
    with finer(rows.sparkSession):
        found = parts.select("name", "vec").toPandas()
    return {name: np.asarray(vec, dtype=float) for name, vec in zip(found["name"], found["vec"])}


def _offsets(rows, folds):
    return {int(r["scope"]): float(r["offset"]) for r in target_transform(rows, folds).collect()}


def _triangle(size):
    return np.triu_indices(size)


def _square(packed, size):
    """A symmetric matrix from its upper triangle."""
    out = np.zeros((size, size))
    out[_triangle(size)] = packed
    return out + np.triu(out, 1).T


def rbf_ridge(rows, maps, grid, folds, scopes):
    """Fit every ridge candidate for every scope from one distributed pass."""
    offsets, size = _offsets(rows, folds), maps.size
    specs = {(c["representation"], c["parameters"]["gamma"]) for c in grid}
    shared = rows.sparkSession.sparkContext.broadcast(maps)

    def add(x, cols):
        upper = _triangle(size)
        for scope in scopes:
            train = (cols["fold"] != scope) & ~np.isnan(cols["y"].astype(float))
            t = cols["y"][train] - offsets[scope]
            for spec, phi in shared.value.many(x.take(train), scope, specs).items():
                yield f"{scope}|{spec}", np.concatenate([(phi.T @ phi)[upper], phi.T @ t])

    sums = array_sums(rows, ("fold", "y"), add)
    fitted = []
    for c in grid:
        spec, alpha = (c["representation"], c["parameters"]["gamma"]), c["parameters"]["alpha"]
        for scope in scopes:
            flat = sums[f"{scope}|{spec}"]
            w = np.linalg.solve(_square(flat[:-size], size) + alpha * np.eye(size), flat[-size:])
            fitted.append((c["id"], scope, *spec, offsets[scope], w))
    return fitted


class NotConverged(RuntimeError):
    """A fit hasn't settled within the passes it was given."""


#: Steps along a Newton direction whose losses one pass computes.
STEPS = (1.0, 0.5, 0.25, 0.125, 0.0625, 0.015625, 0.00390625)


class _Tube:
    """State of one candidate and scope: weights, direction, and the equations at the weights ``known``."""

    def __init__(self, size, c, w=None):
        self.w, self.d, self.c = np.zeros(size) if w is None else w, np.zeros(size), c
        self.gram, self.known, self.objective = np.zeros((size, size)), None, None
        self.done, self.passes = False, 0

    def value(self, step, loss):
        w = self.w + step * self.d
        return 0.5 * w @ w + self.c * loss


#: From this many rows on, and four times as many, a fit starts from the weights that about as many rows give.
FIRST = 50_000


def rbf_eps_regression(rows, maps, grid, folds, scopes, tolerance=1e-9, most_passes=60, first=FIRST):
    """Fit every epsilon-insensitive candidate for every scope until its weights settle.

    Minimises ``|w|^2 / 2 + C * sum(max(0, |residual| - epsilon)^2)`` over all rows by
    Newton steps. A pass adds up the loss along each open direction and what changes
    in the equations of the rows outside the tube at the full step; a step that
    doesn't lower the objective enough is shortened. Settled fits leave the passes; one
    that hasn't settled after ``most_passes`` is an error. The minimum is unique, so
    the first weights, of some rows by a hash of their entries, only save passes.
    """
    offsets = _offsets(rows, folds)
    states = {(c["id"], s): _Tube(maps.size, c["parameters"]["C"]) for c in grid for s in scopes}
    share = rows.count() // first
    if share >= 4:
        some = rows.select("fold", "y", "idx", "val").where(F.pmod(F.xxhash64("idx", "val", "y"), F.lit(share)) == 0)
        near = {k: _Tube(maps.size, v.c * share) for k, v in states.items()}
        _newton(stored(some, "first-rows"), maps, grid, offsets, near, tolerance, most_passes)
        states = {k: _Tube(maps.size, v.c, near[k].w) for k, v in states.items()}
    _newton(rows, maps, grid, offsets, states, tolerance, most_passes)
    late = sorted(k for k, v in states.items() if not v.done)
    if late:
        raise NotConverged(f"not settled after {most_passes} passes: {late}")
    return [(c["id"], s, c["representation"], c["parameters"]["gamma"], offsets[s], states[c["id"], s].w) for c in grid for s in scopes]


def _newton(rows, maps, grid, offsets, states, tolerance, most_passes):
    """Newton passes over the rows until every state is done or ``most_passes`` are made."""
    size, upper = maps.size, _triangle(maps.size)
    settings = {c["id"]: (c["representation"], c["parameters"]["gamma"], c["parameters"]["epsilon"]) for c in grid}
    shared, steps = rows.sparkSession.sparkContext.broadcast(maps), np.array(STEPS)[:, None]
    for _ in range(most_passes):
        going = {k: (v.w, v.d, v.known) for k, v in states.items() if not v.done}
        if not going:
            break

        def add(x, cols, going=going):
            for scope in sorted({s for _, s in going}):
                train = (cols["fold"] != scope) & ~np.isnan(cols["y"].astype(float))
                t = cols["y"][train] - offsets[scope]
                now = [c for c, s in going if s == scope]
                maps_now = shared.value.many(x.take(train), scope, {settings[c][:2] for c in now})
                for cid in now:
                    phi, epsilon = maps_now[settings[cid][:2]], settings[cid][2]
                    w, d, known = going[cid, scope]
                    at, along = (phi @ np.stack([w, d], 1)).T
                    at = t - at
                    beyond = np.abs(at - steps * along)
                    beyond -= epsilon
                    losses = np.square(np.maximum(beyond, 0, out=beyond), out=beyond).sum(1)
                    r = at - along
                    out = np.abs(r) > epsilon
                    was = np.zeros(len(t), bool) if known is None else np.abs(at if known is w else t - phi @ known) > epsilon
                    come, gone = phi[out & ~was], phi[was & ~out]
                    change = come.T @ come - gone.T @ gone
                    yield f"{cid}|{scope}", np.concatenate([change[upper], phi.T @ np.where(out, t - np.sign(r) * epsilon, 0.0), losses, [np.sum(out != was)]])

        sums = array_sums(rows, ("fold", "y"), add)
        for cid, scope in going:
            state, flat = states[cid, scope], sums.get(f"{cid}|{scope}")
            if flat is None:  # no rows
                state.done = True
                continue
            target, losses = flat[len(upper[0]) : len(upper[0]) + size], flat[-len(STEPS) - 1 : -1]
            state.passes += 1
            values = [state.value(step, loss) for step, loss in zip(STEPS, losses)]
            if state.objective is not None and values[0] > state.objective * (1 + 1e-12):
                best = int(np.argmin(values))
                # the equations at a shorter step are those of the next pass
                state.w, state.d, state.objective = state.w + STEPS[best] * state.d, np.zeros(size), min(values[best], state.objective)
                continue
            state.w, state.objective = state.w + state.d, values[0]
            state.known = state.w
            if flat[-1]:
                state.gram = state.gram + _square(flat[: len(upper[0])], size)
            new = np.linalg.solve(state.gram + np.eye(size) / (2.0 * state.c), target)
            state.d = new - state.w
            state.done = np.abs(state.d).max() <= tolerance * max(1.0, np.abs(state.w).max())


class KernelModel:
    """One fitted kernel candidate of one scope."""

    def __init__(self, maps, scope, representation, gamma, offset, weights):
        self.maps, self.scope, self.spec, self.offset, self.weights = maps, scope, (representation, gamma), offset, weights

    def predict(self, x, made=None):
        """Predictions of a block; ``made`` holds features that are made already."""
        phi = self.maps.features(x, self.scope, *self.spec) if made is None else made[self.spec]
        return phi @ self.weights + self.offset


def predict_block(x, models, width):
    """Predictions of ``Entries`` by each of ``[(candidate, model)]``; kernel models of a scope share their projections, others read a dense block."""
    kernels = [m for _, m in models if isinstance(m, KernelModel)]
    alike = {(id(m.maps), m.scope) for m in kernels}
    made = kernels[0].maps.many(x, kernels[0].scope, {m.spec for m in kernels}) if len(alike) == 1 else None
    block = x.dense(width) if len(kernels) < len(models) else None
    for cid, model in models:
        yield cid, model.predict(x, made) if isinstance(model, KernelModel) else model.predict(block)


def kernel_models(maps, fitted):
    """Fitted candidates as models by scope: {scope: [(candidate, model)]}."""
    out = {}
    for cid, scope, *rest in fitted:
        out.setdefault(scope, []).append((cid, KernelModel(maps, scope, *rest)))
    return out


def predict_models(rows, models, keys, width, scope="scope"):
    """Score each row with every candidate of its scope, one Arrow batch at a time; a non-finite result is an error."""
    shared = rows.sparkSession.sparkContext.broadcast(models)
    kept = rows.select(*keys, scope, "idx", "val")
    names, ids = [*keys, scope], sorted({cid for own in models.values() for cid, _ in own})

    def score(batches):
        models = shared.value
        for batch in (b.slice(i, CHUNK) for b in batches for i in range(0, b.num_rows, CHUNK)):
            x, scopes = Entries(batch.num_rows, *entries(batch)), column(batch, scope)
            found = np.full((batch.num_rows, len(ids)), np.nan)
            for s in np.unique(scopes):
                mine = scopes == s
                for cid, p in predict_block(x.take(mine), models.get(s if isinstance(s, str) else int(s), ()), width):
                    if not np.isfinite(p).all():
                        raise ValueError("model returned non-finite predictions")
                    found[mine, ids.index(cid)] = p
            flat = found.ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(ids)), pa.array(flat, mask=np.isnan(flat)))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], lists], [*names, "found"])

    # one row per row and model is made in the JVM, so keys are sent back once
    wide = kept.mapInArrow(score, kept.drop("idx", "val").schema.add("found", T.ArrayType(T.DoubleType())))
    pairs = F.arrays_zip(F.array(*map(F.lit, ids)).cast("array<string>"), "found")
    return wide.select(*names, F.inline(pairs)).toDF(*names, "candidate", "prediction").where(F.col("prediction").isNotNull())


def predict_kernel(rows, maps, fitted, keys, scope="scope"):
    """Score each row with every kernel candidate of its scope."""
    return predict_models(rows, kernel_models(maps, fitted), keys, maps.width, scope)


def linear_dot(weights):
    """Inner product of a row's entries with a ``map<int,double>`` of weights, inside the JVM."""
    return F.aggregate(F.arrays_zip("idx", "val"), F.lit(0.0),
                       lambda acc, e: acc + e["val"] * F.coalesce(F.try_element_at(weights, e["idx"]), F.lit(0.0)))


def linear_predict(rows, models, keys):
    """Score rows with linear models ``(model keys, intercept, weights map<int,double>)`` inside the JVM.

    The model table has one row per population and family.
    """
    joined = rows.join(F.broadcast(models), list(keys))
    return joined.withColumn("prediction", F.col("intercept") + linear_dot("weights")).drop("intercept", "weights")
