"""Mixing sources to target weights by hash-threshold histograms.

Each source's budget is a share of all words; a document is taken ``floor(target / source size)`` times, and once more if its hash lies
below its source's threshold. The threshold comes from histograms: words by source and leading hash bits, then only the bucket in which
the budget ends is refined by the next bits, until it is one hash. What shares that hash are equal rows: they are numbered, range by
range, and as many of them are taken as the budget still holds. No other document is sorted or leaves its row.

Defined cases: a null text has size 0; a null source is a source of its own, last; rows that differ in any column (of a type that can be
hashed) have hashes of their own, so which of equal rows is taken can't be seen; a source without words has target 0; very long texts are counted whole; an empty table gives
an empty result; other columns count for the hash alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.llm.scratch import Scratch

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
#: Bits of the hash that each round looks at, and rounds; together 60 of 64 bits.
BITS, ROUNDS = 12, 5
WORD = r"[^\x20\x09-\x0D]+"


def rank_sources(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds ``place``, 0 up by code point with null last. Ranges are numbered apart, so no task sees all sources."""
    key = F.col("source").asc_nulls_last()
    dealt = scratch.save(sources.repartitionByRange(key).withColumn("part", F.spark_partition_id()), "sources")
    # one row per range
    before = dealt.groupBy(F.col("part").alias("p")).agg(F.count("*").alias("n")).select("p", (F.sum("n").over(Window.orderBy("p")) - F.col("n")).alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(key)) - 1
    return dealt.join(before, F.col("part") == F.col("p")).withColumn("place", place).drop("part", "p", "before")


def targets(sources: DataFrame, weights: Sequence[float], share: float, most: float, scratch: Scratch) -> DataFrame:
    """source, source_size and target. ``sources``: source, source_size.

    Targets stop at ``most`` times the source's size; what is over is shared again by weight among the others, until none is above.
    """
    table = rank_sources(sources, scratch).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("place").cast("int") % len(weights) + 1))
    table = scratch.save(table.withColumn("most", F.col("source_size") * F.lit(float(most))), "weights")
    left = float(share) * (table.agg(F.sum("source_size")).first()[0] or 0)
    level, n_full = 0.0, -1  # words for each unit of weight; a source is full where its weight times that reaches its limit
    while True:
        full = F.col("weight") * F.lit(level) >= F.col("most")
        n, used, open_weight = table.agg(F.count_if(full), F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("weight")))).first()
        if n == n_full or not open_weight:
            break
        n_full, level = n, max(0.0, left - (used or 0.0)) / open_weight
    return table.select("source", "source_size", F.least(F.col("most"), F.col("weight") * F.lit(level)).alias("target"))


def _hash(docs: DataFrame) -> Column:
    """64 bits of a whole row."""
    own = [F.col(f"`{f.name}`") for f in sorted(docs.schema.fields, key=lambda f: f.name) if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    return F.xxhash64(*own)


def _size() -> Column:
    return F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def thresholds(docs: DataFrame, weights: Sequence[float], share: float, most: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The sized documents (doc_id, source, size, hash), and of each source (s): source_size, target, whole copies, the hash bound below
    which a document is taken once more, and the words left for those of that very hash."""
    sized = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), _size().alias("size"), _hash(docs).alias("hash"))
    sized = scratch.save(sized, "sizes")
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most, scratch)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = goal.withColumn("whole", F.floor(ratio)).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    # prefix: leading bits of the bucket in which the budget ends; rest: words still to take in it
    state = goal.select("source", "rest", F.lit(0).cast("long").alias("prefix"))
    for r in range(ROUNDS):
        shift = 64 - BITS * (r + 1)
        bucket = F.shiftrightunsigned(F.col("hash"), shift).alias("bucket")
        s = state.select(F.col("source").alias("s"), "rest", "prefix")
        inside = sized.where("size > 0")
        if r:
            inside = inside.join(s, F.col("source").eqNullSafe(F.col("s")) & (F.shiftrightunsigned(F.col("hash"), shift + BITS) == F.col("prefix")))
        counted = inside.groupBy("source", bucket).agg(F.sum("size").alias("n"))
        up = Window.partitionBy("source").orderBy("bucket")  # at most 4096 rows a source
        ends = counted.join(s, F.col("source").eqNullSafe(F.col("s"))).withColumn("before", F.sum("n").over(up) - F.col("n")).where("before <= rest and rest < before + n")
        found = ends.select(F.col("s"), F.col("bucket").alias("ends"), (F.col("rest") - F.col("before")).alias("left"), "n")
        state = state.join(found, F.col("source").eqNullSafe(F.col("s")), "left").select(
            "source", F.coalesce("left", F.lit(0.0)).alias("rest"),
            F.coalesce("ends", F.when(F.col("rest") > 0, F.shiftleft("prefix", BITS) + (1 << BITS)).otherwise(F.shiftleft("prefix", BITS))).alias("prefix"),
        )
        state = scratch.save(state, "bounds")
    bound = goal.join(state.select(F.col("source").alias("s"), F.col("prefix").alias("bound"), F.col("rest").alias("left")), F.col("source").eqNullSafe(F.col("s")))
    return sized, scratch.save(bound.select("s", "source_size", "target", "whole", "bound", "left"), "thresholds")


def _with_copies(rows: DataFrame, bound: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows with source, size and hash, joined to their source's bound, and ``copies``."""
    rows = rows.join(bound, F.col("source").eqNullSafe(F.col("s")))
    leading = F.shiftrightunsigned("hash", 64 - BITS * ROUNDS)
    ends = (leading == F.col("bound")) & (F.col("size") > 0) & (F.col("left") > 0)
    apart = rows.where(~ends).withColumn("copies", F.col("whole") + (leading < F.col("bound")).cast("long"))
    # equal rows in which a budget ends: numbered by words, first in each range and then over ranges
    tied = scratch.save(rows.where(ends).withColumns({"range": F.spark_partition_id(), "nth": F.monotonically_increasing_id()}), "tied")
    before = tied.groupBy(F.col("s").alias("t"), F.col("range").alias("r")).agg(F.sum("size").alias("n"))
    before = before.withColumn("before", F.sum("n").over(Window.partitionBy("t").orderBy("r")) - F.col("n"))  # one row a range and source
    up = Window.partitionBy("s", "range").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    to = F.col("before") + F.sum("size").over(up)
    tied = tied.join(before, F.col("s").eqNullSafe(F.col("t")) & (F.col("range") == F.col("r")))
    tied = tied.withColumn("copies", F.col("whole") + (to - F.col("size") / 2 <= F.col("left")).cast("long"))
    return apart.unionByName(tied.drop("range", "nth", "t", "r", "n", "before"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies (times it is taken) and taken (words)."""
    scratch = Scratch(docs.sparkSession, "mixing")
    sized, bound = thresholds(docs, weights, share, most, scratch)
    return _with_copies(sized, bound, scratch).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The mix itself: each row of ``docs``, all its columns, as often as it is taken."""
    scratch = Scratch(docs.sparkSession, "mixing")
    _, bound = thresholds(docs, weights, share, most, scratch)
    rows = docs.select(F.struct("*").alias("row"), F.col("source").cast("string").alias("source"), _size().alias("size"), _hash(docs).alias("hash"))  # apart from the bounds' names
    rows = _with_copies(rows, bound, scratch)
    return rows.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")
