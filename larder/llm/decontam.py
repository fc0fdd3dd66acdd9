"""Benchmark decontamination by greedy string tiling.

Seeds are runs of ``SEED`` words. A document and an item that share one are tiled: the longest matches of unmarked words are marked
again and again, found by running Karp-Rabin hashes, until none has ``SEED`` words. The share of the item's words under tiles is its
coverage; as tiles may stand anywhere, a reordered passage counts like one in order. At ``COVERAGE`` the document is contaminated.

The benchmark goes to the workers in blocks of bounded size, each against all documents; documents are not shuffled, so a passage that
very many of them hold burdens no single task. Equal items are one in a block, with their number, so copies do not make it larger.

Defined cases: words are runs other than ASCII white space, A-Z as a-z; an item of fewer than ``SEED`` words has one seed, its whole
sequence, and is covered where a document holds it; null or empty texts match nothing; a null doc_id or item_id is given out as it is;
equal rows give equal results; a repeated item counts as each of its rows; very long texts are searched whole; an empty table of documents or items gives no pairs. Other
columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm import kernels as K
from larder.llm.scratch import Scratch

SEED = 5
COVERAGE = 0.5
#: Benchmark words in one block, about; a seed takes 20 bytes or so on each worker.
BLOCK_WORDS = 1_000_000
OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_item_words", pa.int64()), ("n_tiles", pa.int64()), ("n_tiled", pa.int64()), ("longest", pa.int64()), ("coverage", pa.float64())])
DDL = "doc_id long, item_id long, n_item_words long, n_tiles long, n_tiled long, longest long, coverage double"


def _windows(h: np.ndarray, k: int) -> np.ndarray:
    """Running Karp-Rabin hashes of k consecutive words, one for each place that has them."""
    base = K.U64(0x9E3779B97F4A7C15)
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, K.U64)
    inverse = K.U64(pow(int(base), -1, 1 << 64))
    down = np.multiply.accumulate(np.concatenate(([K.U64(1)], np.full(len(h), inverse, K.U64))))
    up = np.multiply.accumulate(np.concatenate(([K.U64(1)], np.full(len(h), base, K.U64))))
    c = np.concatenate((np.zeros(1, K.U64), np.cumsum(h * up[: len(h)], dtype=K.U64)))
    return (c[k:] - c[:n]) * down[:n]


def tile(doc: np.ndarray, item: np.ndarray, least: int = SEED, places: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Tiles (place in doc, place in item, length) of greedy string tiling; longest first, then by place.

    ``places``: where in doc a match of ``least`` words may begin; all places if not given.
    """
    least = min(least, len(item))
    if least == 0 or len(doc) < least:
        return []
    free_d, free_i = np.ones(len(doc), bool), np.ones(len(item), bool)
    if places is None:
        places = np.arange(len(doc) - least + 1)
    tiles: list[tuple[int, int, int]] = []
    search = max(least, min(len(doc), len(item)))
    while True:
        at = defaultdict(list)
        for j, x in enumerate(_windows(item, search).tolist()):
            if free_i[j : j + search].all():
                at[x].append(j)
        running = _windows(doc, search)
        found: list[tuple[int, int, int]] = []
        for i in places[places < len(running)].tolist() if at else ():
            for j in at.get(int(running[i]), ()):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and free_d[i + n] and free_i[j + n]:
                    n += 1
                if n >= search:
                    found.append((n, i, j))
        longest = max(found, default=(0,))[0]
        if longest > 2 * search:  # far longer ones exist: those first
            search = longest
            continue
        for n, i, j in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
            if free_d[i : i + n].all() and free_i[j : j + n].all():
                free_d[i : i + n] = free_i[j : j + n] = False
                tiles.append((i, j, n))
        if search == least and not found:
            return tiles
        if free_i.sum() < least:
            return tiles
        search = max(least, search // 2)


def _items(rows: list) -> list[tuple[int | None, np.ndarray]]:
    column = pa.array([r[1] for r in rows], pa.string())
    data, at = K.text_bytes(column)
    begin, end, first = K.words(data, at)
    h = K.word_hashes(data, begin, end)
    return [(r[0], h[x:y]) for r, x, y in zip(rows, first[:-1], first[1:], strict=True)]


class _Seeds:
    """Seeds of a block of items, by length (items shorter than ``SEED`` have seeds of their own length)."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]]):
        self.items = items
        self.by: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k in sorted({min(SEED, len(h)) for _, h in items} - {0}):
            found = [(n, _hash(h, k)) for n, (_, h) in enumerate(items) if min(SEED, len(h)) == k]
            seed = np.concatenate([x for _, x in found])
            owner = np.concatenate([np.full(len(x), n) for n, x in found])
            order = np.lexsort((owner, seed))
            seed, owner = seed[order], owner[order]
            new = np.concatenate(([True], (seed[1:] != seed[:-1]) | (owner[1:] != owner[:-1])))
            seed, owner = seed[new], owner[new]
            known, start = np.unique(seed, return_index=True)
            self.by[k] = known, np.append(start, len(seed)), owner


def _hash(h: np.ndarray, k: int) -> np.ndarray:
    return K.shingles(h, np.array([0, len(h)]), k, short=False)[0]


class Finder:
    """Finds documents that hold items of a block of the benchmark; seeds are made on the worker, once."""

    def __init__(self, rows: list, coverage: float, copies: list[int] | None = None):
        self.rows, self.coverage, self.copies, self._seeds = rows, coverage, copies, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_seeds": None}

    def find(self, texts: pa.Array) -> Iterator[tuple]:
        """(row, item_id, n_item_words, n_tiles, n_tiled, longest, coverage) of each pair at or above the coverage."""
        if self._seeds is None:
            self._seeds = _Seeds(_items(self.rows))
        items = self._seeds.items
        all_data, all_at = K.text_bytes(texts)
        for i, j in K.parts(all_at):
            data, at = all_data[all_at[i] : all_at[j]], all_at[i : j + 1] - all_at[i]
            begin, end, first = K.words(data, at)
            h = K.word_hashes(data, begin, end)
            for k, (known, start, owner) in self._seeds.by.items():
                window, wat = K.shingles(h, first, k, short=False)
                where = np.searchsorted(known, window)
                where[where == len(known)] = 0
                hit = np.flatnonzero(known[where] == window)
                hits: dict[tuple[int, int], list[int]] = defaultdict(list)
                docs = np.searchsorted(wat, hit, "right") - 1
                for p, d, s in zip((hit - wat[docs]).tolist(), docs.tolist(), where[hit].tolist(), strict=True):
                    for n in owner[start[s] : start[s + 1]].tolist():
                        hits[d, n].append(p)
                for (d, n), p in sorted(hits.items()):
                    own, item = h[first[d] : first[d + 1]], items[n][1]
                    if len(p) * k < self.coverage * len(item):  # tiles cover no more than the seeds do
                        continue
                    tiles = tile(own, item, SEED, np.array(p))
                    tiled = sum(x[2] for x in tiles)
                    if tiled >= self.coverage * len(item):
                        for _ in range(self.copies[n] if self.copies else 1):
                            yield i + d, items[n][0], len(item), len(tiles), tiled, max(x[2] for x in tiles), tiled / len(item)


def _blocks(benchmark: DataFrame, coverage: float, block_words: int) -> Iterator[Finder]:
    """Finders of the whole benchmark; a block is read to the driver and sent out whole, and its size is bounded."""
    items = benchmark.groupBy(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).agg(F.count("*").alias("n"))
    n_words = items.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0] or 0
    blocks = -(-n_words // block_words) or 1
    for n in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == n)
        rows = own.orderBy("item_id", "text").collect()
        yield Finder([(r.item_id, r.text) for r in rows], coverage, [r.n for r in rows])


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds: doc_id, item_id, n_item_words, n_tiles, n_tiled, longest, coverage."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def run_with(finder: Finder):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = list(finder.find(b.column(1)))
                at = pa.array([x[0] for x in found], pa.int64())
                yield K.batch(OUT, b.column(0).take(at), *([x[c] for x in found] for c in range(1, 7)))

        return run

    scratch, out, last = Scratch(docs.sparkSession, "decontamination"), None, None
    for finder in _blocks(benchmark, coverage, block_words):
        if last is not None:  # pairs of a block are written before the next is read: the driver holds one at a time
            last = scratch.save(last, "pairs")
            out = last if out is None else out.unionByName(last)
        last = rows.mapInArrow(K.tidy(run_with(finder)), DDL)
    return last if out is None else out.unionByName(last)


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs``, all their columns, that hold no benchmark item.

    What a block of the benchmark leaves is written before the next block is read, so the driver holds one at a time.
    """
    place = docs.columns.index("text")

    def run_with(finder: Finder):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                good = np.ones(b.num_rows, bool)
                good[[x[0] for x in finder.find(b.column(place).cast(pa.string()))]] = False
                yield b.filter(pa.array(good))

        return run

    scratch, left = Scratch(docs.sparkSession, "decontamination"), None
    for n, finder in enumerate(_blocks(benchmark, coverage, block_words)):
        if left is not None:
            before, docs = docs, scratch.save(left, "clean")
            if n > 1:
                scratch.drop(before)
        left = docs.mapInArrow(K.tidy(run_with(finder)), docs.schema)
    return left
