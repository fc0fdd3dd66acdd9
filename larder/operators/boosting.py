"""Gradient boosted trees for quantiles (pinball loss) and for counts with many zeros (Tweedie deviance), fitted by histograms.

All models of a call (levels times folds) grow together: each level of their trees is one pass over the rows, which counts gradients by
node, feature and bin inside each partition; the counts are added up over partitions and the best splits chosen, model by model, on the
workers. Only splits and leaves come to the driver: their number follows from depth and models, not from the rows. Counts are whole
numbers (gradients of the pinball loss are counts, those of the Tweedie deviance are rounded to 2**-16), so neither partitioning nor a
repeated task changes a model. After a tree is grown, its leaves are refitted: to the level's quantile of the residuals in a leaf, or by a Newton
step. Between rounds the predictions are written to the shared folder, so a lost executor costs one pass.

A row's features are bins, a byte each: 0 stands for a missing value, the others for ranges with about equally many values. Quantiles
are taken over values kept to ``DIGITS`` binary digits, which are few whatever the rows, so that counts of them can be added up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.sources.shared import fresh

BINS, DIGITS, LEAST_EXPONENT = 64, 7, -10
#: Rounding of Tweedie gradients, and bounds of a log prediction.
UNIT, STEEP = 1 << 16, 30.0
#: Rows that a task works on at a time.
ROWS = 1 << 15
#: Partial sums that one task adds up.
FAN_IN = 64


@dataclass(frozen=True)
class Model:
    """What a model is fitted to: rows up to ``origin``, and a quantile ``level``, or the Tweedie deviance if there is none."""

    fold: int
    origin: date
    level: float | None = None

    @property
    def last(self) -> int:
        return (self.origin - date(1970, 1, 1)).days


@dataclass
class Tree:
    """A binary tree in heap order: node n has children 2n + 1 and 2n + 2. ``feature`` is -1 where a node has no split."""

    depth: int
    feature: np.ndarray = field(init=False)
    bin: np.ndarray = field(init=False)
    gain: np.ndarray = field(init=False)
    cover: np.ndarray = field(init=False)
    value: np.ndarray = field(init=False)

    def __post_init__(self):
        n = 2 ** (self.depth + 1) - 1
        self.feature, self.bin = np.full(n, -1, np.int32), np.zeros(n, np.int32)
        self.gain, self.cover, self.value = np.zeros(n), np.zeros(n, np.int64), np.zeros(n)

    def places(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins."""
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            f = self.feature[node]
            split = f >= 0
            if not split.any():
                break
            right = x[np.arange(len(x)), np.maximum(f, 0)] > self.bin[node]
            node = np.where(split, 2 * node + 1 + right, node)
        return node

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.places(x)]


def coded(v: np.ndarray) -> np.ndarray:
    """Values as whole numbers in the same order, kept to ``DIGITS`` binary digits; those below 2**LEAST_EXPONENT are 0."""
    half = 1 << (DIGITS - 1)
    m, e = np.frexp(np.abs(v))
    c = (e - LEAST_EXPONENT).astype(np.int64) * half + np.rint(m * (half * 2)).astype(np.int64) - half
    return np.where(c > 0, c, 0) * np.sign(v).astype(np.int64)


def decoded(c: np.ndarray) -> np.ndarray:
    half = 1 << (DIGITS - 1)
    a = np.abs(c)
    return np.sign(c) * np.ldexp((a % half + half) / (half * 2), (a // half + LEAST_EXPONENT).astype(np.int64)) * (a > 0)


def quantile_of(codes: np.ndarray, counts: np.ndarray, level: float) -> float:
    """The least value that at least this share of all is not above; ``codes`` in order."""
    if not len(codes):
        return 0.0
    up = np.cumsum(counts)
    return float(decoded(codes[np.searchsorted(up, level * up[-1] * (1 - 1e-12))]))


def tweedie(y: np.ndarray, f: np.ndarray, power: float) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the deviance by the log prediction, as whole multiples of 1 / UNIT."""
    f = np.clip(f, -STEEP, STEEP)
    a, b = y * np.exp((1 - power) * f), np.exp((2 - power) * f)
    return np.rint((b - a) * UNIT).astype(np.int64), np.rint(((power - 1) * a + (2 - power) * b) * UNIT).astype(np.int64)


def histogram(x: np.ndarray, y: np.ndarray, f: np.ndarray, node: np.ndarray, depth: int, level: float | None, power: float, features: int) -> np.ndarray:
    """Whole-number sums (kinds, nodes of this depth, features, bins) over rows that are in one of these nodes."""
    base, nodes = 2**depth - 1, 2**depth
    at = np.flatnonzero((node >= base) & (node < base + nodes))
    kinds = [None, y < f] if level is not None else [None, *tweedie(y, f, power)]
    out = np.zeros((len(kinds), nodes, features, BINS), np.int64)
    if len(at):
        place = (((node[at] - base)[:, None] * features + np.arange(features)) * BINS + x[at]).ravel()
        for k, w in enumerate(kinds):
            if w is None:
                out[k] = np.bincount(place, minlength=out[k].size).reshape(out[k].shape)
            else:  # whole numbers below 2**53 in all: exact
                out[k] = np.bincount(place, np.repeat(w[at].astype(float), features), out[k].size).reshape(out[k].shape).astype(np.int64)
    return out


def splits(sums: np.ndarray, level: float | None, least: int, smooth: float) -> list[tuple[int, int, int, float, int, int]]:
    """The best split of each node: (node, feature, bin, gain, rows, rows on the left). Ties: the first feature, then the first bin."""
    n = sums[0].astype(float)
    g, h = (sums[1] - level * n, n) if level is not None else (sums[1] / UNIT, sums[2] / UNIT)
    score = lambda a, b: a * a / (b + smooth)
    left_n, left_g, left_h = (v.cumsum(axis=2) for v in (n, g, h))
    all_n, all_g, all_h = (v[:, :, -1:] for v in (left_n, left_g, left_h))
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = score(left_g, left_h) + score(all_g - left_g, all_h - left_h) - score(all_g, all_h)
    gain = np.where((left_n >= least) & (all_n - left_n >= least), np.round(gain, 9), -np.inf)
    out = []
    for node in range(len(n)):
        best = int(gain[node].argmax())
        f, b = divmod(best, BINS)
        if gain[node, f, b] > 0:
            out.append((node, f, b, float(gain[node, f, b]), int(all_n[node, 0, 0]), int(left_n[node, f, b])))
    return out


# Passes over the rows ---------------------------------------------------------------------------------------------------


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, some ten thousands at a time."""
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= ROWS:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _unpacked(b: pa.RecordBatch, n_models: int, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bins, targets, predictions and days of a batch."""
    x = np.frombuffer(b"".join(b.column("x").to_pylist()), np.uint8).reshape(-1, features)
    f = np.frombuffer(b"".join(b.column("f").to_pylist()), np.float64).reshape(-1, n_models)
    return x, b.column("y").to_numpy(zero_copy_only=False), f, b.column("day").to_numpy()


PART = pa.schema([("model", pa.int32()), ("salt", pa.int32()), ("sums", pa.binary())])


def _partial(models: Sequence[Model], features: int, work: Callable, add: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each model with what ``work`` (model number, x, y, f) gives for the training rows of a partition, added by ``add``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total: dict[int, np.ndarray] = {}
        for b in _chunks(batches):
            x, y, f, day = _unpacked(b, len(models), features)
            for m, model in enumerate(models):
                own = (day <= model.last) & ~np.isnan(y)
                if own.any():
                    now = work(m, x[own], y[own], f[own, m])
                    total[m] = add([total[m], now]) if m in total else now
        salt = TaskContext.get().partitionId() // FAN_IN
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([salt] * len(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], schema=PART)

    return run


def _summed(rows: DataFrame, run: Callable, add: Callable, shape: Callable[[bytes, int], np.ndarray]) -> DataFrame:
    """Sums of each model, added up by ``FAN_IN`` partitions at a time."""
    parts, left = rows.mapInArrow(run, "model int, salt int, sums binary"), rows.rdd.getNumPartitions()

    def merged(t: pa.Table) -> pa.Table:
        m, salt = t["model"][0].as_py(), t["salt"][0].as_py()
        total = add([shape(v, m) for v in t["sums"].to_pylist()])
        return pa.table([[m], [salt // FAN_IN], [total.tobytes()]], schema=PART)

    while left > FAN_IN:
        parts, left = parts.groupBy("model", "salt").applyInArrow(merged, "model int, salt int, sums binary"), -(-left // FAN_IN)
    return parts


def _best_splits(rows: DataFrame, models: Sequence[Model], trees: Sequence[Tree], depth: int, features: int, least: int, smooth: float, power: float) -> None:
    """Gives the trees their splits at this depth."""

    def work(m: int, x: np.ndarray, y: np.ndarray, f: np.ndarray) -> np.ndarray:
        return histogram(x, y, f, trees[m].places(x), depth, models[m].level, power, features)

    add = lambda parts: np.sum(parts, axis=0)
    shape = lambda v, m: np.frombuffer(v, np.int64).reshape(-1, 2**depth, features, BINS)
    kind = pa.schema([("model", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("bin", pa.int32()), ("gain", pa.float64()), ("n", pa.int64()), ("n_left", pa.int64())])

    def best(t: pa.Table) -> pa.Table:
        m = t["model"][0].as_py()
        found = splits(add([shape(v, m) for v in t["sums"].to_pylist()]), models[m].level, least, smooth)
        columns = list(zip(*found, strict=True)) if found else [[]] * 6
        return pa.table([[m] * len(found), *map(list, columns)], schema=kind)

    sums = _summed(rows, _partial(models, features, work, add), add, shape)
    ddl = "model int, node int, feature int, bin int, gain double, n long, n_left long"
    for r in sums.groupBy("model").applyInArrow(best, ddl).collect():  # nodes of a depth, for each model
        tree, node = trees[r.model], 2**depth - 1 + r.node
        tree.feature[node], tree.bin[node], tree.gain[node] = r.feature, r.bin, r.gain
        tree.cover[[node, 2 * node + 1, 2 * node + 2]] = r.n, r.n_left, r.n - r.n_left


def leaf_sums(node: np.ndarray, y: np.ndarray, f: np.ndarray, level: float | None, power: float) -> np.ndarray:
    """Rows (leaf, code of the residual, number) for a level, or (leaf, first and second derivative, number)."""
    if level is not None:
        code = coded(y - f)
        low = code.min(initial=0)
        wide = int(code.max(initial=0) - low) + 1
        key, n = np.unique(node * wide + (code - low), return_counts=True)
        return np.stack((key // wide, key % wide + low, n)).astype(np.int64)
    g, h = tweedie(y, f, power)
    leaf, at = np.unique(node, return_inverse=True)
    add = lambda v: np.bincount(at, v.astype(float), len(leaf)).astype(np.int64)
    return np.stack((leaf, add(g), add(h), np.bincount(at, minlength=len(leaf)))).astype(np.int64)


def added_leaves(parts: list[np.ndarray], level: float | None) -> np.ndarray:
    both = np.concatenate(parts, axis=1)
    keys = both[:2] if level is not None else both[:1]
    keys, at = np.unique(keys, axis=1, return_inverse=True)
    values = both[len(keys) :]
    out = np.zeros((len(values), keys.shape[1]), np.int64)
    for k, v in enumerate(values):
        np.add.at(out[k], at.ravel(), v)
    return np.concatenate((keys, out))


def leaf_values(sums: np.ndarray, level: float | None, smooth: float, root: bool) -> list[tuple[int, float, int]]:
    """(leaf, value, rows) of each leaf."""
    out = []
    for leaf in np.unique(sums[0]).tolist():
        own = sums[:, sums[0] == leaf]
        if level is not None:
            out.append((leaf, quantile_of(own[1], own[2], level), int(own[2].sum())))
            continue
        g, h, n = own[1].sum() / UNIT, own[2].sum() / UNIT, int(own[3].sum())
        # at the start the prediction is 1, and the derivative tells the mean
        value = float(np.log(max(1 - g / n, 1e-9))) if root else float(-g / (h + smooth)) if h + smooth > 0 else 0.0
        out.append((leaf, value, n))
    return out


def _refit(rows: DataFrame, models: Sequence[Model], trees: Sequence[Tree], features: int, smooth: float, power: float, root: bool) -> None:
    """Gives the leaves their values."""
    work = lambda m, x, y, f: leaf_sums(trees[m].places(x), y, f, models[m].level, power)
    height = lambda m: 3 if models[m].level is not None else 4
    add = lambda parts: added_leaves(parts, 0.5 if len(parts[0]) == 3 else None)
    shape = lambda v, m: np.frombuffer(v, np.int64).reshape(height(m), -1)

    def values(t: pa.Table) -> pa.Table:
        m = t["model"][0].as_py()
        found = leaf_values(add([shape(v, m) for v in t["sums"].to_pylist()]), models[m].level, smooth, root)
        return pa.table({"model": pa.array([m] * len(found), pa.int32()), "leaf": pa.array([x for x, _, _ in found], pa.int32()), "value": pa.array([x for _, x, _ in found], pa.float64()), "n": pa.array([x for _, _, x in found], pa.int64())})

    sums = _summed(rows, _partial(models, features, work, add), add, shape)
    for r in sums.groupBy("model").applyInArrow(values, "model int, leaf int, value double, n long").collect():  # leaves of a tree, for each model
        trees[r.model].value[r.leaf], trees[r.model].cover[r.leaf] = r.value, r.n


def _grown(rows: DataFrame, trees: Sequence[Tree], features: int, path: str) -> DataFrame:
    """Rows with the predictions after these trees, written and read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _chunks(batches):
            x, _, f, _ = _unpacked(b, len(trees), features)
            f = np.ascontiguousarray(f + np.stack([t.predict(x) for t in trees], axis=1))
            yield b.set_column(b.schema.get_field_index("f"), "f", pa.array([f[i].tobytes() for i in range(len(f))], pa.binary()))

    rows.mapInArrow(run, rows.schema).write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


# Bins -------------------------------------------------------------------------------------------------------------------


def edges(rows: DataFrame, features: Sequence[str], until: date) -> dict[str, np.ndarray]:
    """Upper edges of each feature's bins: quantiles of its values up to ``until``, at most BINS - 2 of them."""
    names = list(features)
    kind = pa.schema([("feature", pa.int32()), ("code", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _chunks(batches):
            for k, name in enumerate(names):
                v = b.column(name).to_numpy(zero_copy_only=False)
                code, n = np.unique(coded(v[np.isfinite(v)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), k, np.int32)), pa.array(code), pa.array(n.astype(np.int64))], schema=kind)

    counts = rows.where(F.col("date") <= F.lit(until)).select(*names).mapInArrow(run, "feature int, code long, n long").groupBy("feature", "code").agg(F.sum("n").alias("n"))

    def cut(t: pa.Table) -> pa.Table:
        order = np.argsort(t["code"].to_numpy())
        code, up = t["code"].to_numpy()[order], np.cumsum(t["n"].to_numpy()[order])
        at = np.unique(np.searchsorted(up, up[-1] * np.arange(1, BINS - 1) / (BINS - 1)))
        return pa.table({"feature": pa.array([t["feature"][0].as_py()], pa.int32()), "edges": pa.array([decoded(code[at[at < len(code)]]).tolist()], pa.list_(pa.float64()))})

    # values kept to a few binary digits: some thousands of a feature at most
    found = {r.feature: np.array(r.edges) for r in counts.groupBy("feature").applyInArrow(cut, "feature int, edges array<double>").collect()}
    return {name: found.get(k, np.zeros(0)) for k, name in enumerate(names)}


def binned_matrix(columns: Sequence[np.ndarray], bounds: Sequence[np.ndarray]) -> np.ndarray:
    """A byte for each row and feature: 0 for missing, else 1 and the number of edges below the value."""
    out = np.zeros((len(columns[0]), len(columns)), np.uint8)
    for k, (v, e) in enumerate(zip(columns, bounds, strict=True)):
        fine = np.isfinite(v)
        out[fine, k] = 1 + np.searchsorted(e, decoded(coded(v[fine])), "left")
    return out


def binned(rows: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, bounds: dict[str, np.ndarray], n_models: int) -> DataFrame:
    """keys, day (days since 1970), y, x (bins) and f (predictions, all 0)."""
    keys, names = list(keys), list(features)
    own = rows.select(*keys, F.unix_date("date").alias("day"), F.col(target).cast("double").alias("y"), *(F.col(c).cast("double").alias(c) for c in names))
    ddl = ", ".join(f"{c} {t}" for c, t in own.select(*keys).dtypes) + ", day int, y double, x binary, f binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = binned_matrix([b.column(c).to_numpy(zero_copy_only=False) for c in names], [bounds[c] for c in names])
            packed = pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (*keys, "day", "y")), packed, pa.array([bytes(8 * n_models)] * len(x), pa.binary())], names=[*keys, "day", "y", "x", "f"])

    return own.mapInArrow(run, ddl)


# Fit --------------------------------------------------------------------------------------------------------------------


@dataclass
class Boosted:
    """Fitted models: their trees, and the rows with a prediction of each (``keys``, day, y, x, f)."""

    models: Sequence[Model]
    features: Sequence[str]
    bounds: dict[str, np.ndarray]
    trees: list[list[Tree]]
    rows: DataFrame

    def nodes(self, spark: SparkSession) -> DataFrame:
        """A row for each node: model, fold, level, round, node, feature, threshold (greatest value to the left; null for a leaf), gain, cover, value."""
        out = []
        for m, (model, trees) in enumerate(zip(self.models, self.trees, strict=True)):
            for r, t in enumerate(trees):
                for n in np.flatnonzero(t.cover > 0).tolist():
                    f = int(t.feature[n])
                    e = self.bounds[self.features[f]] if f >= 0 else None
                    threshold = None if f < 0 else float("-inf") if t.bin[n] == 0 else float(e[t.bin[n] - 1]) if t.bin[n] <= len(e) else float("inf")
                    out.append((m, model.fold, model.level, r, n, self.features[f] if f >= 0 else None, threshold, float(t.gain[n]), int(t.cover[n]), float(t.value[n])))
        return spark.createDataFrame(out, "model int, fold int, level double, round int, node int, feature string, threshold double, gain double, cover long, value double")


def fit(rows: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, models: Sequence[Model], rounds: int = 20, depth: int = 4, rate: float = 0.2, least: int = 50, smooth: float = 1e-3, power: float = 1.1) -> Boosted:
    """Models fitted on the rows (with ``date``) up to their origins; predictions for all rows, those after the origins too.

    Rows without a target are predicted, not learned from. ``rounds`` trees of ``depth`` after the first constant, each shrunk by
    ``rate``; a leaf has at least ``least`` rows.
    """
    spark, features = rows.sparkSession, list(features)
    base = fresh(spark, "boosting")
    bounds = edges(rows, features, max(m.origin for m in models))
    start = binned(rows, keys, features, target, bounds, len(models))
    start.write.parquet(f"{base}/0")
    now, at = spark.read.schema(start.schema).parquet(f"{base}/0"), f"{base}/0"
    grown: list[list[Tree]] = [[] for _ in models]
    for r in range(rounds + 1):
        trees = [Tree(depth if r else 0) for _ in models]
        for d in range(trees[0].depth):
            _best_splits(now, models, trees, d, len(features), least, smooth, power)
        _refit(now, models, trees, len(features), smooth, power, root=r == 0)
        for m, t in enumerate(trees):
            t.value *= rate if r else 1.0
            grown[m].append(t)
        path = f"{base}/{r + 1}"
        now, old, at = _grown(now, trees, len(features), path), at, path
        jvm = spark._jvm.org.apache.hadoop.fs.Path(old)
        jvm.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm, True)
    return Boosted(models, features, bounds, grown, now)


def predictions(fitted: Boosted, keys: Sequence[str], horizon: int) -> DataFrame:
    """keys, fold, origin_date, level (null: the mean) and yhat of the days after each model's origin; at least 0."""
    models = fitted.models
    kind = ", ".join(f"{c} {t}" for c, t in fitted.rows.select(*keys).dtypes) + ", fold int, origin_date date, level double, yhat double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _chunks(batches):
            f, day = np.frombuffer(b"".join(b.column("f").to_pylist()), np.float64).reshape(b.num_rows, -1), b.column("day").to_numpy()
            for m, model in enumerate(models):
                own = np.flatnonzero((day > model.last) & (day <= model.last + horizon))
                value = np.maximum(0.0, f[own, m]) if model.level is not None else np.exp(np.clip(f[own, m], -STEEP, STEEP))
                columns = [b.column(c).take(pa.array(own)) for c in keys]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([model.fold] * len(own), pa.int32()), pa.array([model.origin] * len(own), pa.date32()), pa.array([model.level] * len(own), pa.float64()), pa.array(value)], names=[*keys, "fold", "origin_date", "level", "yhat"])

    return fitted.rows.select(*keys, "day", "f").mapInArrow(run, kind)


# Why --------------------------------------------------------------------------------------------------------------------


def leaf_paths(tree: Tree) -> Iterator[tuple[float, dict[int, tuple[int, int, float]]]]:
    """Each leaf's value, and for each feature on its path the bins that lead there (above, up to) and the share of rows that take them."""

    def walk(node: int, path: dict[int, tuple[int, int, float]]) -> Iterator[tuple[float, dict[int, tuple[int, int, float]]]]:
        f = int(tree.feature[node])
        if f < 0:
            yield float(tree.value[node]), path
            return
        low, high, share = path.get(f, (-1, 255, 1.0))
        for child, a, b in ((2 * node + 1, low, min(high, int(tree.bin[node]))), (2 * node + 2, max(low, int(tree.bin[node])), high)):
            yield from walk(child, {**path, f: (a, b, share * tree.cover[child] / tree.cover[node])})

    yield from walk(0, {})


def attributions(trees: Sequence[Tree], x: np.ndarray) -> tuple[np.ndarray, float]:
    """Shapley values of each row and feature, where a feature left out follows the rows' shares, and the value with all left out.

    A leaf counts for a coalition by the product, over the features of its path, of whether the row takes the path (in it) or of the
    share of rows that do (out of it); the sum over coalitions comes from a polynomial in the coalition's size.
    """
    from math import factorial

    phi, base = np.zeros(x.shape), 0.0
    for tree in trees:
        for value, path in leaf_paths(tree):
            names, d = list(path), len(path)
            shares = np.array([path[f][2] for f in names])
            base += value * float(np.prod(shares))
            if not d:
                continue
            took = np.stack([(x[:, f] > path[f][0]) & (x[:, f] <= path[f][1]) for f in names], axis=1).astype(float)
            weight = np.array([factorial(s) * factorial(d - s - 1) / factorial(d) for s in range(d)])
            for i in range(d):
                # by size of the coalition among the others: products of "took" inside and shares outside
                poly = np.zeros((len(x), d))
                poly[:, 0] = 1.0
                for j in range(d):
                    if j != i:
                        poly[:, 1:] = poly[:, 1:] * shares[j] + poly[:, :-1] * took[:, j, None]
                        poly[:, 0] *= shares[j]
                phi[:, names[i]] += value * (took[:, i] - shares[i]) * (poly @ weight)
    return phi, base


def importance(fitted: Boosted, only: Sequence[int], sample: int, seed: int) -> DataFrame:
    """fold, feature, method, value of the models numbered in ``only``: gain, split, and the mean size of Shapley values (shap_mean_abs)
    over ``sample`` training rows chosen by hash, of the prediction before any exponential."""
    spark, names = fitted.rows.sparkSession, fitted.features
    nodes = fitted.nodes(spark).where(F.col("model").isin(list(only)) & F.col("feature").isNotNull())
    every = spark.createDataFrame([(fitted.models[m].fold, n) for m in only for n in names], "fold int, feature string")
    sums = nodes.groupBy("fold", "feature").agg(F.sum("gain").alias("gain"), F.count("*").cast("double").alias("split"))
    both = every.join(sums, ["fold", "feature"], "left").na.fill(0.0).unpivot(["fold", "feature"], ["gain", "split"], "method", "value")
    parts = [both]
    for m in only:
        model, trees = fitted.models[m], fitted.trees[m]
        past = fitted.rows.where((F.col("day") <= model.last) & F.col("y").isNotNull())
        some = past.orderBy(F.xxhash64("x", "day", "y", F.lit(seed)), "x", "day", "y").limit(sample).select("x")

        def run(batches: Iterator[pa.RecordBatch], trees: Sequence[Tree] = trees) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    phi, _ = attributions(trees, np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(b.num_rows, -1))
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.abs(phi).sum(axis=0)), pa.array([len(phi)] * len(names), pa.int64())], names=["feature", "total", "n"])

        mean = some.repartition(8).mapInArrow(run, "feature string, total double, n long").groupBy("feature").agg((F.sum("total") / F.sum("n")).alias("value"))
        parts.append(mean.select(F.lit(model.fold).alias("fold"), "feature", F.lit("shap_mean_abs").alias("method"), "value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
