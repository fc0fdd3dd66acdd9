"""Hard negatives by segment summaries: rows of other labels that score nearly as high as an anchor's positives.

Components become whole numbers and scores their inner products, so everything is exact. Each row is held with the mean and the
deviation of its segments. The product of two segments is their length times (product of means), and at most their length times
(product of deviations) more or less, so sums over the segments bound a score from both sides. Segments become shorter from level to
level of ``SEGMENTS``: at each, pairs whose bounds show that they can't be among the answers fall away, and what remains is scored.

Rows are dealt into parts of about ``PART`` rows, and anchors are streamed against the parts, so a task holds one part and one batch of
anchors, whatever their number. Two passes: the best rows of the same label (parts of one label, of which a large one has many), then,
for each anchor with its positives, the best rows of the others inside the window of each positive. A part gives at most ``positives``
or ``positives * negatives`` rows of an anchor, which are ranked at the end. All anchors meet all rows, in blocks, as the search asks.

Defined cases: rows with a null label or vector, or a null or non-finite component, take no part; an empty vector scores 0, and a
shorter one counts as if zeros followed. Components beyond 2**25 after scaling are held at that bound, so sums fit a long. Repeated
rows are rows of their own: one may be the other's positive. A row without vec_id is no anchor; as a candidate it stands after those of
its score. An anchor without another row of its label has no rows, and so has a positive with nothing in its window; a positive with a
score below 0 has an empty window. Ties go to the smaller vec_id. An empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm import kernels as K
from larder.llm.scratch import Scratch

POSITIVES, NEGATIVES = 5, 5
#: Score of a negative in hundredths of its positive's.
WINDOW = (80, 100)
#: Components in a segment, coarse to fine.
SEGMENTS = (16, 4, 2)
#: Rows of a part.
PART = 65536
SCALE, BOUND = 256, 1 << 25
#: Share of pairs from which all are computed, which is then quicker than some.
MANY = 1 / 8
ANCHOR_BATCH = 32

_BEST = "anchor long, anchor_id long, vec_id long, rid long, score long"
_HARD = "anchor long, anchor_id long, positive_rank int, positive_id long, positive_score long, negative_id long, rid long, negative_score long"
BEST = pa.schema([(c, pa.int64()) for c in ("anchor", "anchor_id", "vec_id", "rid", "score")])
HARD = pa.schema([("anchor", pa.int64()), ("anchor_id", pa.int64()), ("positive_rank", pa.int32()), *((c, pa.int64()) for c in ("positive_id", "positive_score", "negative_id", "rid", "negative_score"))])


class Summaries:
    """Whole-number vectors with the means and deviations of their segments, scaled so that plain products give the bounds."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.levels = []
        for size in SEGMENTS:
            pad = -x.shape[1] % size
            s = np.pad(x, ((0, 0), (0, pad))).reshape(len(x), -1, size)
            mean = s.mean(axis=2)
            self.levels.append((mean * np.sqrt(size), np.sqrt(np.maximum(((s - mean[:, :, None]) ** 2).sum(axis=2), 0))))

    def bounds(self, other: Summaries, level: int, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest scores of the pairs that are open; minus infinity for the others."""
        (m, d), (p, q) = self.levels[level], other.levels[level]
        low, high = np.full(open_.shape, -np.inf), np.full(open_.shape, -np.inf)
        a, b = np.nonzero(open_)
        if len(a) > MANY * open_.size:
            mid, off = (m @ p.T)[a, b], (d @ q.T)[a, b]
        else:
            mid, off = _products(m, p, a, b), _products(d, q, a, b)
        slack = 1 + 1e-9 * (np.abs(mid) + off)
        low[a, b], high[a, b] = mid - off - slack, mid + off + slack
        return low, high

    def scores(self, other: Summaries, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, rows of ``other`` and exact scores of the pairs that are open."""
        a, b = np.nonzero(open_)
        x, y = self.x, other.x
        if float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * max(1, x.shape[1]) >= 2**53:
            x, y = x.astype(np.int64), y.astype(np.int64)  # else all sums of whole numbers are exact in float64
        return a, b, ((x @ y.T)[a, b] if len(a) > MANY * open_.size else _products(x, y, a, b)).astype(np.int64)


def _products(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows a of x with rows b of y, one by one."""
    out = np.zeros(len(a), x.dtype)
    for i in range(0, len(a), 1 << 15):
        out[i : i + (1 << 15)] = np.einsum("ij,ij->i", x[a[i : i + (1 << 15)]], y[b[i : i + (1 << 15)]])
    return out


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest of each row; minus infinity where there are fewer."""
    return np.partition(values, -k, axis=1)[:, -k] if values.shape[1] >= k else np.full(len(values), -np.inf)


def _first(order: list[np.ndarray], group: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each group, by ``order`` (its last key counts most)."""
    at = np.lexsort([*order, group])
    g = group[at]
    start = np.flatnonzero(np.append(True, g[1:] != g[:-1])[: len(g)])
    return at[np.arange(len(g)) - np.repeat(start, np.diff(np.append(start, len(g)))) < k]


def _id_order(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return ids.is_null().to_numpy(zero_copy_only=False).astype(np.int8), ids.fill_null(0).to_numpy()


def best_of_part(anchors: Summaries, rows: Summaries, open_: np.ndarray, ids: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score): of the open pairs, the ``k`` best rows of a part for each anchor."""
    for level in range(len(SEGMENTS)):
        low, high = anchors.bounds(rows, level, open_)
        open_ = open_ & (high >= _kth(low, k)[:, None])
    a, b, score = anchors.scores(rows, open_)
    gone, number = _id_order(ids)
    top = _first([number[b], gone[b], -score], a, k)
    return a[top], b[top], score[top]


def hard_of_part(anchors: Summaries, rows: Summaries, open_: np.ndarray, positive: np.ndarray, ids: pa.Array, k: int, window: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, rank of the positive, row, score): of the open pairs, the ``k`` best rows in the window of each positive score (nan: none)."""
    lower, upper = window
    real = np.where(positive >= 0, positive, np.nan)
    least = np.where(np.isnan(real), np.inf, real).min(axis=1, initial=np.inf)
    floor, ceiling = least * lower / 100 - 1, np.where(np.isnan(real), -np.inf, real).max(axis=1, initial=-np.inf) * upper / 100 + 1
    for level in range(len(SEGMENTS)):
        low, high = anchors.bounds(rows, level, open_)
        # k rows surely under the top of every window: what is surely less than all of them is not asked for
        sure = _kth(np.where(high <= least[:, None] * upper / 100, low, -np.inf), k)
        open_ = open_ & (high >= np.maximum(floor, sure)[:, None]) & (low <= ceiling[:, None])
    a, b, score = anchors.scores(rows, open_)
    gone, number = _id_order(ids)
    found = []
    for rank in range(positive.shape[1]):
        p = np.nan_to_num(positive[a, rank], nan=-1).astype(np.int64)
        inside = np.flatnonzero((p >= 0) & (lower * p <= 100 * score) & (100 * score <= upper * p))
        at = inside[_first([number[b[inside]], gone[b[inside]], -score[inside]], a[inside], k)]
        found.append((a[at], np.full(len(at), rank), b[at], score[at]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _matrix(column: pa.Array) -> np.ndarray:
    """A row for each vector of whole numbers, with zeros after shorter ones."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.to_numpy(zero_copy_only=False)
    size = np.diff(at)
    out = np.zeros((len(size), int(size.max(initial=0))))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = flat[at[0] : at[-1]]
    return out


def _wide(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x


def _streamed(work: Callable[[pa.Table, Summaries, pa.RecordBatch, Summaries], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows sorted by part and kind (0: rows of the part, 1: anchors), each batch of anchors with the part before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, ready = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            mark, kind = np.array(b.column("part").to_pylist(), object), b.column("kind").to_numpy()
            cut = np.flatnonzero(np.append(True, (mark[1:] != mark[:-1]) | (kind[1:] != kind[:-1])))
            for i, j in zip(cut.tolist(), [*cut[1:].tolist(), b.num_rows], strict=True):
                piece = b.slice(i, j - i)
                if mark[i] != part:
                    part, held, ready = mark[i], [], None
                if kind[i] == 0:
                    held.append(piece)
                    continue
                if not held:
                    continue  # anchors of a part without rows
                if ready is None:
                    rows = pa.Table.from_batches(held).combine_chunks()
                    ready = rows, _matrix(rows["v"])
                for s in range(0, piece.num_rows, ANCHOR_BATCH):
                    some = piece.slice(s, ANCHOR_BATCH)
                    x = _matrix(some.column("v"))
                    width = max(x.shape[1], ready[1].shape[1])
                    if not isinstance(ready[-1], Summaries) or ready[-1].x.shape[1] < width:
                        ready = ready[0], ready[1], Summaries(_wide(ready[1], width))
                    yield work(ready[0], ready[-1], some, Summaries(_wide(x, ready[-1].x.shape[1])))

    return K.tidy(run)


def _best(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(rows: pa.Table, held: Summaries, anchors: pa.RecordBatch, x: Summaries) -> pa.RecordBatch:
        rid, own, ids = rows["rid"].to_numpy(), anchors.column("rid").to_numpy(), rows["vec_id"].chunk(0)
        a, b, score = best_of_part(x, held, own[:, None] != rid[None, :], ids, k)
        return K.batch(BEST, own[a], anchors.column("vec_id").take(pa.array(a)), ids.take(pa.array(b)), rid[b], score)

    return _streamed(work)


def _hard(k: int, window: tuple[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(rows: pa.Table, held: Summaries, anchors: pa.RecordBatch, x: Summaries) -> pa.RecordBatch:
        found = anchors.column("found")
        at = np.append(0, np.cumsum(pa.compute.list_value_length(found).to_numpy()))
        scores, names = found.flatten().field("score").to_numpy(), found.flatten().field("vec_id")
        size = np.diff(at)
        positive = np.full((len(size), int(size.max(initial=1))), np.nan)
        row = np.repeat(np.arange(len(size)), size)
        positive[row, np.arange(len(row)) - at[row]] = scores
        ids = rows["vec_id"].chunk(0)
        other = anchors.column("label").to_numpy()[:, None] != rows["label"].to_numpy()[None, :]
        a, rank, b, score = hard_of_part(x, held, other, positive, ids, k, window)
        one = at[a] + rank
        return K.batch(HARD, anchors.column("rid").to_numpy()[a], anchors.column("vec_id").take(pa.array(a)), rank, names.take(pa.array(one)), scores[one], ids.take(pa.array(b)), rows["rid"].to_numpy()[b], score)

    return _streamed(work)


def taking_part(rows: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, label, v: rows that take part, with whole-number components."""
    source = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col(vector).cast("array<double>").alias("x"))
    fine = F.col("label").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf"))))
    whole = F.transform("x", lambda c: F.floor(F.greatest(F.lit(float(-BOUND)), F.least(F.lit(float(BOUND)), c * scale))).cast("int"))
    return source.where(fine).select("vec_id", "label", whole.alias("v"))


def _met(rows: DataFrame, anchors: DataFrame, parts: int) -> DataFrame:
    """Rows and anchors of a part in one partition, the rows first."""
    both = rows.withColumn("kind", F.lit(0)).unionByName(anchors.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    return both.repartition(max(parts, both.sparkSession.sparkContext.defaultParallelism), "part").sortWithinPartitions("part", "kind")


def mine(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of ``rows`` (vec_id, label, v), for rows where ``anchor``."""
    scratch = Scratch(rows.sparkSession, "negatives")
    named = ["rid", "vec_id", "label", "v"]
    numbered = scratch.save(rows.withColumn("rid", F.monotonically_increasing_id()).select(*named), "rows")  # written, so numbers stay
    sizes = scratch.save(numbered.groupBy("label").agg(F.count("*").alias("n"), F.ceil(F.count("*") / PART).cast("int").alias("parts")).withColumnRenamed("label", "l"), "sizes")
    n, own_parts = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("parts"), F.lit(0))).first()
    parts = max(1, -(-n // PART))
    heads = numbered.where(anchor)
    name = lambda k: F.concat_ws("/", F.col("label").cast("string"), k.cast("string")).alias("part")
    sized = F.col("label") == F.col("l")
    dealt = numbered.join(sizes, sized).select(*named, name(F.pmod(F.xxhash64("rid"), F.col("parts"))))
    near = heads.join(sizes, sized).select(*named, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("k")).select(*named, name(F.col("k")))
    best = _met(dealt, near, own_parts).select("part", "kind", "rid", "vec_id", "v").mapInArrow(_best(positives), _BEST)
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "rid")
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives)
    found = F.transform(F.array_sort(F.collect_list(F.struct("rank", "score", "vec_id"))), lambda s: F.struct(s["score"].alias("score"), s["vec_id"].alias("vec_id")))
    best = scratch.save(best.groupBy(F.col("anchor").alias("a")).agg(found.alias("found")), "positives")
    # the stated anchors meet all rows, in parts
    dealt = numbered.select(*named, F.pmod(F.xxhash64("rid"), F.lit(parts)).cast("string").alias("part"))
    far = heads.join(best, F.col("rid") == F.col("a")).select(*named, "found", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("k")).withColumn("part", F.col("k").cast("string")).drop("k")
    hard = _met(dealt, far, parts).select("part", "kind", "rid", "vec_id", "label", "v", "found").mapInArrow(_hard(negatives, window), _HARD)
    order = Window.partitionBy("anchor", "positive_rank").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"), "rid")
    hard = hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return hard.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def relabelled(rows: DataFrame) -> DataFrame:
    """``rows`` (vec_id, label, ...) with another label where vec_id is divisible by 7."""
    return rows.withColumn("label", F.when(F.expr("vec_id % 7 = 0"), F.expr("(label + 1) % 10")).otherwise(F.col("label")))


ORACLE = """
    WITH raw AS (SELECT CAST(vec_id AS BIGINT) AS id, CAST(label AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
    fine AS (SELECT id, label, x FROM raw WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
    v AS (SELECT id, CASE WHEN id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(x, lambda c: floor(256 * c)) AS v, row_number() OVER (ORDER BY id) AS r FROM fine),
    scored AS (SELECT a.id AS anchor_id, a.r AS ar, a.label = b.label AS same, b.id AS other, b.r AS br, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS s FROM v a JOIN v b ON a.r <> b.r WHERE a.id % 100 = 0),
    p AS (SELECT ar, other AS positive_id, s AS positive_score, row_number() OVER (PARTITION BY ar ORDER BY s DESC, other NULLS LAST, br) AS k FROM scored WHERE same QUALIFY k <= 5),
    n AS (SELECT anchor_id, positive_id, positive_score, other AS negative_id, s AS negative_score, row_number() OVER (PARTITION BY p.ar, k ORDER BY s DESC, other NULLS LAST, br) AS rank
      FROM p JOIN scored ON p.ar = scored.ar AND NOT same AND 80 * positive_score <= 100 * s AND 100 * s <= 100 * positive_score QUALIFY rank <= 5)
    SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n"""
