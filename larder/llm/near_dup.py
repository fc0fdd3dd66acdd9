"""Near duplicates by MinHash with tensored banding.

Two small collections of keys are made from few MinHash values: each key of a collection combines ``ROWS`` values. Every pair of a key
from either collection is a table key, so ``2 * KEYS * ROWS`` values serve ``KEYS ** 2`` tables of ``2 * ROWS`` values each. Two
documents meet in a table exactly if they share a key in both collections, with probability (1 - (1 - J**2)**12)**2 here: 0.9999 at
J = 0.75. Keys that one document alone holds are dropped before pairs are formed, as no table key with them can be shared.

Texts with equal sets of shingles are one class, so copies cost one node. In each table, members are compared with its least and its
greatest member by their MinHash values alone, at a loose bound; that gives clusters, which hold every pair worth a check. Inside a
cluster all links are decided on full shingle sets by blocked matrix products, and only links that join parts are given out. So no
table and no cluster is expanded into pairs, whatever its size; large clusters are dealt over pairs of blocks.

Defined cases: a null or empty text has no shingles and is linked with nothing; a text of 1 to 4 words has one shingle; repeated rows
belong to one class; rows without doc_id are members of their class, but its id is the smallest doc_id in it (null if it has none);
``kept`` is then true for null only in a class without ids. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.llm import kernels as K
from larder.llm.graph import components
from larder.llm.scratch import Scratch

WORDS = 5
KEYS, ROWS = 12, 2
SIMILARITY = (75, 100)
#: Share of equal MinHash values from which members of a table are put into one cluster. At J = 0.75 it is missed once in 10**6.
LOOSE = 0.45
#: Classes and shingles in a block of a cluster, about.
BLOCK, BLOCK_SHINGLES = 512, 500_000
COLUMNS = 4096
#: Bits of the filter that keeps shingle sets of unclustered documents from being shuffled: 2 MB at most.
FILTER_BITS = 1 << 24

N_VALUES = 2 * KEYS * ROWS
SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("class", pa.binary()), ("keys", pa.list_(pa.int64())), ("sketch", pa.binary()), ("k1", pa.int64()), ("k2", pa.int32())])
_MULTIPLY, _FLIP = K.seeds(N_VALUES, 5), K.seeds(N_VALUES, 6)


def _sets(data: np.ndarray, at: np.ndarray) -> tuple[list[np.ndarray], list[bytes], np.ndarray, np.ndarray]:
    """Each text's sorted distinct shingles, its class (a digest of them), and all its shingles with their offsets."""
    begin, end, first = K.words(data, at)
    h, start = K.shingles(K.word_hashes(data, begin, end), first, WORDS)
    sets, classes = [], []
    for i, j in zip(start[:-1].tolist(), start[1:].tolist(), strict=True):
        x = np.sort(h[i:j])
        if len(x) > 1:
            x = x[np.concatenate(([True], x[1:] != x[:-1]))]
        sets.append(x)
        classes.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
    return sets, classes, h, start


def _values(h: np.ndarray, start: np.ndarray) -> np.ndarray:
    """MinHash values, a row for each text with shingles."""
    out = np.empty((len(start) - 1, N_VALUES), K.U64)
    for k in range(N_VALUES):
        out[:, k] = np.minimum.reduceat((h ^ _FLIP[k]) * _MULTIPLY[k], start[:-1])
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tag = K.seeds(2 * KEYS, 7)
    for b in batches:
        all_data, all_at = K.text_bytes(b.column(1))
        for i, j in K.parts(all_at):
            sets, classes, h, start = _sets(all_data[all_at[i] : all_at[j]], all_at[i : j + 1] - all_at[i])
            full = np.flatnonzero(np.diff(start))
            keys, sketch = [None] * (j - i), [None] * (j - i)
            if len(full):
                v = _values(h, np.append(start[full], start[-1]))
                key = np.zeros((len(full), 2 * KEYS), K.U64)
                for r in range(ROWS):
                    key = K.mix(key * K.U64(31) + v[:, r :: ROWS])
                key = K.mix(key ^ tag).view(np.int64)
                low = K.mix(v.ravel()).astype(np.uint8).reshape(v.shape)
                for n, x in enumerate(full.tolist()):
                    keys[x], sketch[x] = key[n], low[n].tobytes()
            yield K.batch(SIGNED, b.column(0).slice(i, j - i), [len(x) for x in sets], classes, keys, sketch, b.column(2).slice(i, j - i), b.column(3).slice(i, j - i))


def _alike(pairs: DataFrame) -> DataFrame:
    """Keeps rows whose sketches x and y agree in enough values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, N_VALUES) for c in (2, 3))
                same = (x == y).mean(axis=1) - 1 / 256
                yield b.select([0, 1]).filter(pa.array(same >= LOOSE))

    return pairs.select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def _merged(found: DataFrame, more: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root after more edges: only roots are put together anew."""
    own = lambda s: found.select(F.col("node").alias(f"n{s}"), F.col("root").alias(f"r{s}"))
    roots = more.join(own("a"), F.col("a") == F.col("na"), "left").join(own("b"), F.col("b") == F.col("nb"), "left")
    joined = components(roots.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")), scratch)
    moved = found.join(joined.select(F.col("node").alias("n"), F.col("root").alias("r")), F.col("root") == F.col("n"), "left")
    return moved.select("node", F.coalesce("r", "root").alias("root")).union(joined.join(found.select("node"), "node", "left_anti"))


def clusters(signed: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root, n_shingles: classes that may have links, with their cluster."""
    nodes = scratch.save(signed.where("n_shingles > 0").select("class", "n_shingles", "keys", "sketch").dropDuplicates(["class"]), "classes")
    single = nodes.select("class", F.posexplode("keys").alias("place", "key"))
    shared = single.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("k"))
    live = single.join(shared, F.col("key") == F.col("k")).groupBy("class").agg(
        F.collect_list(F.when(F.col("place") < KEYS, F.col("key"))).alias("g"), F.collect_list(F.when(F.col("place") >= KEYS, F.col("key"))).alias("h"))
    tables = live.select("class", F.explode("g").alias("g"), "h").select("class", "g", F.explode("h").alias("h")).select(F.xxhash64("g", "h").alias("t"), "class")
    of = Window.partitionBy("t")
    tables = tables.select("t", "class", F.min("class").over(of).alias("least"), F.max("class").over(of).alias("most")).where("least <> most")
    tables = scratch.save(tables, "tables")
    pairs = tables.select("class", F.explode(F.array("least", "most")).alias("lead")).where("class <> lead")
    pairs = scratch.save(pairs.select(F.least("class", "lead").alias("a"), F.greatest("class", "lead").alias("b")).distinct(), "pairs")
    sketch = nodes.select("class", "sketch")
    pairs = pairs.join(sketch.select(F.col("class").alias("a"), F.col("sketch").alias("x")), "a").join(sketch.select(F.col("class").alias("b"), F.col("sketch").alias("y")), "b")
    found = components(_alike(pairs), scratch)
    # leads of different clusters that share a table: joined while their sketches agree
    lead = tables.select("t", "class", F.col("class").alias("lead"), F.col("class").alias("last"))
    while True:
        own = lead.join(found, F.col("class") == F.col("node"), "left").select("t", F.coalesce("root", "class").alias("class"), "lead", "last")
        # a table of one cluster stays one: only the others are kept for later rounds, with a row for each cluster
        own = own.repartition("t").groupBy("t", "class").agg(F.min("lead").alias("lead"), F.max("last").alias("last"))
        own = own.withColumn("one", F.min(F.struct("class", "lead")).over(of)).withColumn("most", F.max("class").over(of)).where("one.class <> most")
        lead = scratch.save(own.select("t", "class", "lead", "last", F.when(F.col("class") != F.col("one.class"), F.col("one.lead")).alias("a")), "leads")
        more = lead.where("a is not null").select("a", F.explode(F.array("lead", "last")).alias("b")).distinct()
        more = more.join(sketch.select(F.col("class").alias("a"), F.col("sketch").alias("x")), "a").join(sketch.select(F.col("class").alias("b"), F.col("sketch").alias("y")), "b")
        more = scratch.save(_alike(more), "more")
        if more.isEmpty():
            break
        found = scratch.save(_merged(found, more, scratch), "found")
    scratch.drop(tables)
    return scratch.save(found.join(nodes.select("class", "n_shingles"), F.col("node") == F.col("class")).select("node", "root", "n_shingles"), "clusters")


def _filter_bits(found: DataFrame) -> np.ndarray:
    """A bit for each hash of a clustered class; at most 2 MB, whatever the input."""
    bucket, place = _bit(F.col("node"))
    rows = found.groupBy(bucket.alias("n")).agg(F.bitmap_construct_agg(place).alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 8 + 4096, np.uint8)
    for n, bits in rows:
        out[(n - 1) * 4096 : n * 4096] = np.frombuffer(bits, np.uint8)
    return out


def _shingle_sets(docs: DataFrame, found: DataFrame) -> DataFrame:
    """class and shingles of clustered classes, once each (and of few others, that share a filter bit)."""
    spread = docs.sparkSession.sparkContext.broadcast(_filter_bits(found))
    schema = pa.schema([("class", pa.binary()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        bits, seen = spread.value, set()
        for b in batches:
            all_data, all_at = K.text_bytes(b.column(0))
            for i, j in K.parts(all_at):
                sets, classes, _, _ = _sets(all_data[all_at[i] : all_at[j]], all_at[i : j + 1] - all_at[i])
                give = []
                for n, c in enumerate(classes):
                    at = xxhash.xxh64_intdigest(c, 42) % FILTER_BITS
                    if c not in seen and bits[at // 8] >> (at % 8) & 1:
                        seen.add(c)
                        give.append(n)
                yield K.batch(schema, [classes[n] for n in give], [sets[n].view(np.int64) for n in give])

    return docs.select(F.col("text").cast("string")).mapInArrow(K.tidy(run), "class binary, shingles array<long>")


LINKS = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _block_links(rows: pa.Table) -> pa.Table:
    """Links between the classes of a pair of blocks; only as many as join its parts."""
    ids = rows["class"].to_pylist()
    left = rows["left"].to_numpy(zero_copy_only=False)
    sets = rows["shingles"].combine_chunks()
    at = sets.offsets.to_numpy().astype(np.int64)
    size = np.diff(at)
    flat = sets.flatten().to_numpy()
    who = np.repeat(np.arange(len(ids)), size)
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], who[order]
    new = np.concatenate(([True], flat[1:] != flat[:-1])) if len(flat) else np.zeros(0, bool)
    column = np.cumsum(new) - 1
    often = np.bincount(column) > 1 if len(flat) else np.zeros(0, bool)
    keep = often[column]
    column, who = (np.cumsum(often) - 1)[column[keep]], who[keep]
    common = np.zeros((len(ids), len(ids)), np.float32)
    edge = np.searchsorted(column, np.arange(0, int(often.sum()) + COLUMNS, COLUMNS))
    for n, (i, j) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)):
        hits = np.zeros((len(ids), COLUMNS), np.float32)
        hits[who[i:j], column[i:j] - n * COLUMNS] = 1
        hits = hits[:, : int(column[j - 1]) - n * COLUMNS + 1] if j > i else hits[:, :0]
        common += hits @ hits.T
    common = common.astype(np.int64)
    num, den = SIMILARITY
    linked = np.triu(den * common >= num * (size[:, None] + size[None, :] - common), 1)
    if not left.all():
        linked &= left[:, None] != left[None, :]  # pairs inside a block are judged where it stands alone
    parent = list(range(len(ids)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for x, y in np.argwhere(linked).tolist():
        if (p := root(x)) != (q := root(y)):
            parent[p] = q
            out.append((ids[x], ids[y]))
    return pa.table({"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([y for _, y in out], pa.binary())}, schema=LINKS)


def links(docs: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """a, b: links confirmed on full sets, enough to join all classes that are linked."""
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    size = found.groupBy("root").agg(blocks.alias("blocks")).withColumnRenamed("root", "r")
    placed = found.join(size, F.col("root") == F.col("r")).select("node", "root", "blocks", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int").alias("block"))
    sets = _shingle_sets(docs, found)
    own = placed.join(sets, F.col("node") == F.col("class")).dropDuplicates(["class"])
    # block i meets each block j >= i: as the left one there, as the right one where it is j
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j"), (F.col("block") <= j).alias("left")))
    dealt = own.select("root", "class", "shingles", F.explode(pair).alias("p")).select("root", "p.i", "p.j", "p.left", "class", "shingles")
    return scratch.save(dealt.groupBy("root", "i", "j").applyInArrow(_block_links, "a binary, b binary"), "links")


def _verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class, k1, k2 (the row's own hashes), component_id, kept."""
    scratch = Scratch(docs.sparkSession, "near-dup")
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), *_row_hashes())
    signed = scratch.save(rows.mapInArrow(K.tidy(_sign), "doc_id long, n_shingles long, class binary, keys array<long>, sketch binary, k1 long, k2 int"), "signed")
    found = clusters(signed, scratch)
    joined = components(links(docs, found, scratch), scratch)
    rows = signed.select("doc_id", "n_shingles", "class", "k1", "k2")
    least = rows.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    owned = scratch.save(least.join(joined, F.col("class") == F.col("node"), "left").select("class", "least", "n", "root"), "owned")
    whole = owned.where("root is not null").groupBy(F.col("root").alias("r")).agg(F.min("least").alias("all"))
    named = owned.join(whole, F.col("root") == F.col("r"), "left").select(F.col("class").alias("c"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("all")).alias("component"), "n", "root")
    # a class of one row without links needs no join: its id is its own
    named = scratch.save(named.where("n > 1 or root is not null").select("c", "component"), "named")
    out = rows.join(named, F.col("class") == F.col("c"), "left")
    component = F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", "class", "k1", "k2", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _row_hashes() -> list[Column]:
    own = [F.col("doc_id").cast("long"), F.col("text").cast("string")]
    return [F.xxhash64(*own).alias("k1"), F.hash(*own).alias("k2")]


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    return _verdicts(docs).select("doc_id", "n_shingles", "component_id", "kept")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all their columns, with one document of each component; of rows equal in doc_id and text one stays.

    Rows are told apart by 96 bits of hashes of doc_id and text. Rows that go, or stand more than once, set bits of a filter of 2 MB; the
    others are not shuffled, but for those that share a bit.
    """
    scratch = Scratch(docs.sparkSession, "near-dup")
    verdicts = _verdicts(docs).where("n_shingles > 0")
    go = verdicts.groupBy("k1", "k2").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n")).where("not kept or n > 1")
    go = scratch.save(go.select(F.col("k1").alias("g1"), F.col("k2").alias("g2"), "kept"), "go")
    rows = docs.select(F.struct("*").alias("row"), *_row_hashes())  # apart from the names here
    bucket, place = _bit(F.col("k1"))
    bits = go.select(_bit(F.col("g1"))[0].alias("n"), _bit(F.col("g1"))[1].alias("at")).groupBy("n").agg(F.bitmap_construct_agg("at").alias("bits"))
    rows = rows.withColumns({"bucket": bucket, "at": place}).join(F.broadcast(bits), F.col("bucket") == F.col("n"), "left")  # FILTER_BITS at most
    byte = F.conv(F.hex(F.expr("substring(bits, cast(at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    named = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, cast(at % 8 as int))")) != 0, F.lit(False))
    rows = rows.select("row", "k1", "k2", named.alias("named"))
    same = (F.col("k1") == F.col("g1")) & (F.col("k2") == F.col("g2"))
    # a row whose bit is not set stays where it is; only rows that may be named are moved
    out = rows.where("not named").select("row").unionByName(rows.where("named").join(go, same, "left_anti").select("row"))
    if not go.where("kept").isEmpty():
        out = out.unionByName(rows.where("named").join(go.where("kept"), same, "left_semi").dropDuplicates(["k1", "k2"]).select("row"))
    return out.select("row.*")


def _bit(key: Column) -> tuple[Column, Column]:
    """Bucket and place of a key's bit in a filter of ``FILTER_BITS``; buckets are numbered from 1."""
    at = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS)) + 1
    return F.bitmap_bucket_number(at), F.bitmap_bit_position(at)
