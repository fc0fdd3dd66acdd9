"""Near duplicates among vectors: sign hashes of random hyperplanes, exact cosines, components.

Each vector has a key in every table: the signs of its products with the table's hyperplanes. Planes and vectors are whole numbers, so
keys are the same wherever they are computed. With n different vectors a key has log2(n) + ``SPARE`` signs, so that vectors which are
not alike seldom meet, and there are as many tables as it takes for a pair exactly at the least cosine to meet in one of them but for
``MISS`` of all; pairs above it are missed less. Both numbers follow from n by one rule at every size.

Equal vectors are one class. A class takes as its home the least class that it met in a table, if their angle is at most half the
greatest angle of a link: two classes of one home are linked for certain, by the triangle inequality, and are not compared again. So a
large group of near copies costs about as much as its number of homes. Members of other homes are compared by blocked matrix products
in float64, cosines near the bound anew by exact sums; a pair that meets in several tables is counted in the first. Tables with many members
are dealt over pairs of blocks, in which classes of one home stand together, so that blocks of one home need no comparison. Pairs are
never given out: each class has its number of links in a block, and only links that join parts of a block go to the components.
A large group whose members are alike but far from every home is compared in all pairs of its blocks; only that stays quadratic.

Defined cases: a vector that is null, empty or zero, or holds a null or a component that is not finite, is linked with nothing and is its own
component; so are vectors of different lengths to one another. Repeated rows are vectors of one class, linked with each other. A
component of vectors without vec_id alone has a null id; elsewhere the smallest vec_id counts. ``kept`` is true where vec_id equals
component_id, nulls alike. An empty table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm import kernels as K
from larder.llm.graph import components
from larder.llm.scratch import Scratch

COSINE = 0.95
#: Share of pairs exactly at the least cosine that no table may bring together.
MISS = 0.002
#: Signs of a key beyond log2 of the number of vectors.
SPARE = 3
#: Classes in a block of a table that is dealt over several tasks.
BLOCK = 1024
#: Rows of small tables that are compared in one group, about.
ROWS = 16384

SIGNED = pa.schema([("vec_id", pa.int64()), ("class", pa.binary()), ("vec", pa.binary()), ("keys", pa.list_(pa.int64()))])
COUNTED = pa.schema([("class", pa.binary()), ("links", pa.int64()), ("other", pa.binary())])


def shape(n: int, cosine: float = COSINE) -> tuple[int, int]:
    """Signs of a key and number of tables for n vectors."""
    bits = min(60, math.ceil(math.log2(max(n, 2))) + SPARE)
    meet = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log1p(-meet))


@functools.lru_cache(4)
def _planes(width: int, n: int) -> np.ndarray:
    return np.rint(1000 * np.random.default_rng(11).standard_normal((n, width)).T)


def keys(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """A key for each row and table. All sums are of whole numbers below 2**53, so their order does not matter."""
    exponent = np.frexp(np.abs(x).max(axis=1))[1]
    whole = np.rint(np.ldexp(x, (20 - exponent)[:, None]))
    out = np.empty((len(x), tables), K.U64)
    planes = _planes(x.shape[1], bits * tables)
    weights = K.U64(1) << np.arange(bits, dtype=K.U64)
    tag = K.seeds(tables, x.shape[1])
    for t in range(tables):
        signs = whole @ planes[:, t * bits : (t + 1) * bits] >= 0
        out[:, t] = K.mix((signs * weights).sum(axis=1, dtype=K.U64) ^ tag[t])
    return out.view(np.int64)


def _matrix(column: pa.Array) -> list[np.ndarray | None]:
    """Each vector as float64; None where it can have no links."""
    out = []
    for v in column:
        x = None
        if v.is_valid and len(v.values) and not v.values.null_count:
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            x = x + 0.0 if np.isfinite(x).all() and x.any() else None
        out.append(x)
    return out


def _sign(bits: int, tables: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = _matrix(b.column(1))
            own: list = [None] * len(rows)
            for width in {len(x) for x in rows if x is not None}:
                at = [i for i, x in enumerate(rows) if x is not None and len(x) == width]
                for i, k in zip(at, keys(np.stack([rows[i] for i in at]), bits, tables), strict=True):
                    own[i] = k
            vec = [None if x is None else x.tobytes() for x in rows]
            yield K.batch(SIGNED, b.column(0), [None if v is None else hashlib.blake2b(v, digest_size=16).digest() for v in vec], vec, own)

    return K.tidy(run)


def _exact(x: np.ndarray, y: np.ndarray) -> float:
    shift = lambda v: np.ldexp(v, -int(np.frexp(np.abs(v).max())[1]))
    x, y = shift(x), shift(y)
    return math.fsum((x * y).tolist()) / math.sqrt(math.fsum((x * x).tolist()) * math.fsum((y * y).tolist()))


def _unit(x: np.ndarray) -> np.ndarray:
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All components, one vector after another, and where each begins."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].copy().view(np.float64), (at - at[0]) // 8


def _homes(cosine: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Keeps pairs (class, lead, vec, other) whose angle is at most half of a link's, less a margin for rounding."""
    least = math.cos(math.acos(cosine) / 2 - 1e-6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            (x, i), (y, j) = _vectors(b.column(2)), _vectors(b.column(3))
            n, m = np.diff(i), np.diff(j)
            near = np.zeros(b.num_rows, bool)
            for width in np.unique(n[n == m]).tolist():
                rows = np.flatnonzero((n == width) & (m == width))
                at = np.arange(width)
                near[rows] = (_unit(x[i[rows][:, None] + at]) * _unit(y[j[rows][:, None] + at])).sum(axis=1) >= least
            yield b.select([0, 1]).filter(pa.array(near))

    return K.tidy(run)


def _spanning(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int]]:
    """As few of the links (a, b) as join all that they join."""
    nodes, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    near = np.zeros((len(nodes), len(nodes)), bool)
    near[place[: len(a)], place[len(a) :]] = near[place[len(a) :], place[: len(a)]] = True
    fresh = np.ones(len(nodes), bool)
    for start in range(len(nodes)):
        ahead = [start] if fresh[start] else []
        fresh[start] = False
        while ahead:
            u = ahead.pop()
            new = np.flatnonzero(near[u] & fresh)
            fresh[new] = False
            ahead += new.tolist()
            yield from ((int(nodes[u]), v) for v in nodes[new].tolist())


def _compare(cosine: float, bits: int, tables: int) -> Callable[[pa.Table], pa.Table]:
    """Of the rows (key, side, class, home, vec, n) of one group: links of each class, weighed by copies, and links that join homes."""

    def links(x: np.ndarray, apart: np.ndarray, key: int) -> tuple[np.ndarray, np.ndarray]:
        """Linked pairs of rows that are ``apart`` and meet in this table first."""
        unit = _unit(x)
        cos = unit @ unit.T
        a, b = np.nonzero(np.triu((cos >= cosine - 1e-9) & apart, 1))
        good = cos[a, b] >= cosine + 1e-9
        for n in np.flatnonzero(~good).tolist():
            good[n] = _exact(x[a[n]], x[b[n]]) >= cosine
        a, b = a[good], b[good]
        if not len(a):
            return a, b
        used, place = np.unique(np.concatenate((a, b)), return_inverse=True)
        code, p, q = keys(x[used], bits, tables), place[: len(a)], place[len(a) :]
        first = np.empty(len(a), bool)
        for s in range(0, len(a), 1 << 16):
            u, v = p[s : s + (1 << 16)], q[s : s + (1 << 16)]
            first[s : s + (1 << 16)] = code[u, (code[u] == code[v]).argmax(axis=1)] == key
        return a[first], b[first]

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        key = rows["key"].to_numpy()
        homes, home = np.unique(np.array(rows["home"].to_pylist(), object), return_inverse=True)
        side = np.unique(np.array(rows["side"].to_pylist(), object), return_inverse=True)[1]
        crossed = rows["lo"][0].as_py() != rows["hi"][0].as_py()
        copies, counts, joined = rows["n"].to_numpy(), np.zeros(len(rows), np.int64), set()
        flat, at = _vectors(rows["vec"].chunk(0))
        width = np.diff(at)
        order = np.lexsort((width, key))
        new = np.append(True, (key[order][1:] != key[order][:-1]) | (width[order][1:] != width[order][:-1]))
        edge = np.append(np.flatnonzero(new), len(order))
        for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            own = order[i:j]
            apart = home[own][:, None] != home[own][None, :]
            if crossed:
                apart &= side[own][:, None] != side[own][None, :]
            if not apart.any():
                continue
            a, b = links(flat[at[own][:, None] + np.arange(width[own[0]])], apart, key[own[0]])
            if len(a):
                counts[own] += np.bincount(a, copies[own[b]], len(own)).astype(np.int64) + np.bincount(b, copies[own[a]], len(own)).astype(np.int64)
                joined.update(_spanning(home[own[a]], home[own[b]]))
        ids, some = rows["class"].to_pylist(), np.flatnonzero(counts).tolist()
        joined = sorted(joined)
        return pa.table([[*(ids[n] for n in some), *(homes[u] for u, _ in joined)], [*counts[some].tolist(), *([0] * len(joined))], [*([None] * len(some)), *(homes[v] for _, v in joined)]], schema=COUNTED)

    return run


def _dealt(live: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows of tables dealt over groups (g, lo, hi): small tables many to a group, large ones by pairs of blocks."""
    size = scratch.save(live.groupBy("key").agg(F.count("*").alias("m")), "sizes")
    groups = max(1, -(-live.count() // ROWS))
    big = size.where(F.col("m") > BLOCK).select(F.col("key").alias("k"))
    small = live.join(big, F.col("key") == F.col("k"), "left_anti").select(F.pmod("key", F.lit(groups)).alias("g"), F.lit("").alias("lo"), F.lit("").alias("hi"), F.lit("").alias("side"), *live.columns)
    if big.isEmpty():
        return small
    rows = scratch.save(live.join(big, F.col("key") == F.col("k"), "left_semi"), "large")
    parts = lambda n: F.ceil(n / BLOCK).cast("int")
    own = rows.groupBy("key", "home").agg(F.count("*").alias("c"))
    pure = own.where(F.col("c") >= BLOCK // 2).select(F.col("key").alias("pk"), F.col("home").alias("ph"), parts(F.col("c")).alias("parts"))
    rest = own.where(F.col("c") < BLOCK // 2).groupBy(F.col("key").alias("rk")).agg(parts(F.sum("c")).alias("rest"))
    sides = rows.join(pure, (F.col("key") == F.col("pk")) & (F.col("home") == F.col("ph")), "left").join(rest, F.col("key") == F.col("rk"), "left")
    part = F.when(F.col("ph").isNotNull(), F.pmod(F.xxhash64("class"), F.col("parts"))).otherwise(F.pmod(F.xxhash64("home"), F.col("rest")))
    alone = F.when(F.col("ph").isNotNull(), F.hex("home")).otherwise("")
    sides = scratch.save(sides.select(*live.columns, alone.alias("alone"), F.concat(alone, F.lit("/"), part.cast("string")).alias("side")), "sides")
    blocks = sides.groupBy("key", "alone", "side").agg(F.count("*").alias("rows")).select(F.col("key").alias("k"), F.col("alone").alias("far_alone"), F.col("side").alias("far"))
    # two blocks of one home need no comparison; a block of several meets itself too
    met = sides.join(blocks, (F.col("key") == F.col("k")) & ((F.col("alone") == "") | (F.col("alone") != F.col("far_alone"))))
    large = met.select(F.col("key").alias("g"), F.least("side", "far").alias("lo"), F.greatest("side", "far").alias("hi"), "side", *live.columns)
    return small.unionByName(large)


def near_vectors(rows: DataFrame, cosine: float = COSINE, vector: str = "embedding") -> DataFrame:
    """One row per row of ``rows``: vec_id, n_links, component_id, kept; links are pairs with a cosine of ``cosine`` or more."""
    scratch = Scratch(rows.sparkSession, "near-vectors")
    bits, tables = shape(rows.count(), cosine)
    source = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    signed = scratch.save(source.mapInArrow(_sign(bits, tables), "vec_id long, class binary, vec binary, keys array<long>"), "signed")
    usable = signed.where("class is not null")
    copies = scratch.save(usable.groupBy("class").agg(F.count("*").alias("n"), F.min("vec_id").alias("least")), "copies")
    nodes = scratch.save(usable.select("class", "vec", "keys").dropDuplicates(["class"]), "nodes")
    placed = nodes.select("class", F.explode("keys").alias("key"))
    leads = scratch.save(placed.groupBy("key").agg(F.min("class").alias("lead"), F.count("*").alias("m")).where("m > 1").select(F.col("key").alias("k"), "lead"), "leads")
    met = scratch.save(placed.join(leads, F.col("key") == F.col("k")).select("class", "key", "lead"), "met")
    vec = nodes.select("class", "vec")
    pairs = met.where("class <> lead").select("class", "lead").distinct()
    pairs = pairs.join(vec, "class").join(vec.select(F.col("class").alias("lead"), F.col("vec").alias("other")), "lead").select("class", "lead", "vec", "other")
    near = pairs.mapInArrow(_homes(cosine), "class binary, lead binary")
    # a class that is least wherever it was met keeps itself
    homes = scratch.save(near.groupBy(F.col("class").alias("c")).agg(F.min("lead").alias("lead")), "homes")
    own = copies.join(homes, F.col("class") == F.col("c"), "left").select("class", "n", "least", F.coalesce("lead", "class").alias("home"))
    own = scratch.save(own, "own")
    live = met.select("class", "key").join(own.select(F.col("class").alias("c"), "home", "n"), F.col("class") == F.col("c")).join(vec, "class").select("key", "class", "home", "n", "vec")
    dealt = _dealt(scratch.save(live, "live"), scratch)
    counted = dealt.groupBy("g", "lo", "hi").applyInArrow(_compare(cosine, bits, tables), "class binary, links long, other binary")
    counted = scratch.save(counted, "links")
    # classes of one home are linked with one another, so a home is one node
    cells = own.groupBy(F.col("home").alias("h")).agg(F.sum("n").alias("all")).where("all > 1")
    inside = own.join(cells, F.col("home") == F.col("h")).select("class", (F.col("all") - 1).alias("links"))
    links = inside.union(counted.where("other is null").select("class", "links")).groupBy(F.col("class").alias("l")).agg(F.sum("links").alias("n_links"))
    joined = components(counted.where("other is not null").select(F.col("class").alias("a"), F.col("other").alias("b")), scratch)
    named = own.join(joined, F.col("home") == F.col("node"), "left").select("class", "least", F.coalesce("root", "home").alias("root"))
    least = named.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id"))
    named = named.join(least, F.col("root") == F.col("r")).join(links, F.col("class") == F.col("l")).select(F.col("class").alias("c"), "n_links", "component_id")
    named = scratch.save(named, "named")  # classes with links alone
    out = signed.select("vec_id", "class").join(named, F.col("class") == F.col("c"), "left")
    component = F.when(F.col("c").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
