"""Periodic runs of words, found with a grammar made by recompression.

The words of a batch of texts become one sequence of numbers, with a barrier of its own before and after each text. Block compression
(a stretch of one symbol becomes a symbol that holds its length) and pair compression (of two neighbours, one from each half of the
alphabet) alternate until each text is one symbol. Equal stretches are cut alike at every level but for their ends, so how far two places
agree is found by climbing the levels while the symbols agree and stepping down where they stop: a few steps a level, forwards and
backwards alike, and all questions of a batch in one go.

A run of period q and length 3q or more holds two neighbouring places of the grid 0, q, 2q, ..., both inside it. So for each q only those
grid places are asked whose words agree a period apart: n/q places for q, n log n in all. Their agreement both ways gives the whole run.
One stretch found with several periods has the smallest: with a length of three periods all others are its multiples.

Defined cases: a null or empty text has no words and no runs; a text shorter than the least length has no runs; repeated rows, and rows
without doc_id, are judged each by itself; equal words are told by their bytes, case and punctuation included; a very long text is
asked about in pieces of ``ASK`` places, against one grammar over its whole length; an empty table gives an empty table. Columns other
than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm import kernels as K

#: A run has at least so many words, and so many periods.
LEAST, PERIODS = 24, 3
#: Grid places asked about at a time.
ASK = 1 << 20

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])
RESULT = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class Level:
    """Symbols of a level, and how those of the next one hold them.

    ``parent`` is the place in the next level; ``first`` and ``last`` are, for each place of the next level, its first and last child here.
    """

    def __init__(self, symbols: np.ndarray, heads: np.ndarray, blocks: bool):
        """``heads``: whether a symbol begins one of the next level; ``blocks``: whether those are blocks of equal symbols."""
        self.symbols, self.blocks = symbols, blocks
        self.parent = np.cumsum(heads) - 1
        self.first = np.flatnonzero(heads)
        self.last = np.append(self.first[1:], len(symbols)) - 1

    def step(self, x: np.ndarray, y: np.ndarray, equal: np.ndarray, ahead: bool) -> tuple[np.ndarray, np.ndarray]:
        """How far places x and y agree at once here, and whether both then stand at an edge of the next level's symbols."""
        edge = self.last if ahead else self.first
        left, right = np.abs(edge[self.parent[x]] - x) + 1, np.abs(edge[self.parent[y]] - y) + 1
        if self.blocks:
            return np.where(equal, np.minimum(left, right), 0), equal & (left == right)
        whole = (self.last - self.first + 1).take(self.parent[x]), (self.last - self.first + 1).take(self.parent[y])
        inside = (left != whole[0]) | (right != whole[1])
        return (equal & inside).astype(np.int64), equal


def _names(left: np.ndarray, right: np.ndarray, since: int) -> tuple[np.ndarray, int]:
    """A new symbol for each different pair, and the first number not used."""
    _, name = np.unique(left.astype(np.int64) << 32 | right, return_inverse=True)
    return name + since, since + (int(name.max()) + 1 if len(name) else 0)


def grammar(symbols: np.ndarray, since: int) -> list[Level]:
    """Levels up to one symbol between barriers. Barriers are negative and all different; new symbols are numbered from ``since``."""
    levels, now, salt = [], symbols, 0
    while True:
        inner = (now[1:] >= 0) & (now[:-1] >= 0)
        if not inner.any():
            return [*levels, Level(now, np.ones(len(now), bool), True)]
        heads = np.append(True, now[1:] != now[:-1])
        level = Level(now, heads, True)
        size = level.last - level.first + 1
        new = now[level.first].copy()
        long = np.flatnonzero(size > 1)
        new[long], since = _names(new[long], size[long], since)
        levels.append(level)
        now = new
        half = K.mix(now.astype(K.U64) * K.U64(0x9E3779B97F4A7C15) + K.U64(salt)) >> K.U64(63) == 1
        salt += 1
        inner = (now[1:] >= 0) & (now[:-1] >= 0)
        ways = [inner & half[:-1] & ~half[1:], inner & ~half[:-1] & half[1:]]
        pairs = np.flatnonzero(max(ways, key=np.count_nonzero))
        heads = np.ones(len(now), bool)
        heads[pairs + 1] = False
        level = Level(now, heads, False)
        new = now[level.first].copy()
        new[level.parent[pairs]], since = _names(now[pairs], now[pairs + 1], since)
        levels.append(level)
        now = new


def agreement(levels: list[Level], p: np.ndarray, q: np.ndarray, ahead: bool = True) -> np.ndarray:
    """Number of equal symbols from places p and q on (or back, with those places first); p and q differ in each question."""
    x, y, sign = p.astype(np.int64), q.astype(np.int64), 1 if ahead else -1
    stopped = np.full(len(x), len(levels))
    alive = np.arange(len(x))
    for n, level in enumerate(levels):
        a, b = x[alive], y[alive]
        far, on = level.step(a, b, level.symbols[a] == level.symbols[b], ahead)
        x[alive], y[alive] = a + sign * far, b + sign * far
        stopped[alive[~on]] = n
        alive = alive[on]
        if not len(alive):
            break
        x[alive], y[alive] = level.parent[x[alive]], level.parent[y[alive]]
    for n in range(int(stopped.max(initial=0)) - 1, -1, -1):
        level = levels[n]
        down = np.flatnonzero(stopped > n)
        edge = level.first if ahead else level.last
        a, b = edge[x[down]], edge[y[down]]
        equal = level.symbols[a] == level.symbols[b]
        far = level.step(a, b, equal, ahead)[0] if level.blocks else equal.astype(np.int64)
        x[down], y[down] = a + sign * far, b + sign * far
    return np.abs(x - p)


def _grid(symbols: np.ndarray, base: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grid places whose symbols agree a period apart, and the period; about ``ASK`` at a time."""
    place, period, held = [], [], 0
    order = np.argsort(-size, kind="stable")
    base, size = base[order], size[order]
    for q in range(1, int(size[0]) // PERIODS + 1 if len(size) else 0):
        k = int(np.searchsorted(-size, -max(LEAST, PERIODS * q), "right"))
        if k == 0:
            break
        if k == 1:
            row = symbols[base[0] : base[0] + size[0] : q]
            at = base[0] + q * np.flatnonzero(row[1:] == row[:-1])
        else:
            n = (size[:k] - 1) // q
            at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            at = at * q + np.repeat(base[:k], n)
            at = at[symbols[at] == symbols[at + q]]
        if len(at):
            place.append(at)
            period.append(np.full(len(at), q))
            held += len(at)
        if held >= ASK:
            yield np.concatenate(place), np.concatenate(period)
            place, period, held = [], [], 0
    if held:
        yield np.concatenate(place), np.concatenate(period)


def find(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start, length and period of all runs, in this order. ``ids``: the words of all texts; ``first``: each text's first."""
    n = len(first) - 1
    size = np.diff(first)
    symbols = np.empty(len(ids) + n + 1, np.int64)
    bars = first + np.arange(n + 1)
    symbols[bars] = -1 - np.arange(n + 1)
    base = bars[:-1] + 1
    within = np.repeat(base - first[:-1], size) + np.arange(len(ids))
    symbols[within] = ids
    levels, found = None, []
    for at, q in _grid(symbols, base, size):
        levels = levels or grammar(symbols, int(ids.max()) + 1)
        # what agrees after the two places, and before them
        ahead = agreement(levels, at, at + q)
        short = ahead + q
        keep = np.flatnonzero(symbols[at - 1] == symbols[at + q - 1])
        behind = np.zeros(len(at), np.int64)
        behind[keep] = agreement(levels, at[keep] - 1, (at + q)[keep] - 1, ahead=False)
        length = short + behind
        good = length >= np.maximum(LEAST, PERIODS * q)
        found.append(np.unique(np.stack(((at - behind)[good], length[good], q[good])), axis=1))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    start, length, period = np.unique(np.concatenate(found, axis=1), axis=1)
    new = np.append(True, (start[1:] != start[:-1]) | (length[1:] != length[:-1]))[: len(start)]
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]
    text = np.searchsorted(bars, start, "right") - 1
    return text, start - base[text], length, period


def _words(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    size = end - begin
    at = np.concatenate(([0], np.cumsum(size)))
    flat = data[np.arange(at[-1]) + np.repeat(begin - at[:-1], size)]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(flat)])


def _joined(words: pa.Array, kept: np.ndarray, text: np.ndarray, n: int) -> pa.Array:
    """The kept words of each text with one space between them."""
    at = np.frombuffer(words.buffers()[1], np.int64)
    flat = np.frombuffer(words.buffers()[2], np.uint8) if at[-1] else np.zeros(0, np.uint8)
    own, of = np.flatnonzero(kept), text[kept]
    size = (at[1:] - at[:-1])[own]
    gap = np.append(of[1:] == of[:-1], False)[: len(own)].astype(np.int64)
    to = np.concatenate(([0], np.cumsum(size + gap)))
    out = np.full(to[-1], 0x20, np.uint8)
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[within + np.repeat(to[:-1], size)] = flat[within + np.repeat(at[:-1][own], size)]
    ends = to[np.searchsorted(of, np.arange(n + 1))]
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())


def _part(doc_ids: pa.Array, data: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    n = len(at) - 1
    begin, end, first = K.words(data, at)
    words = _words(data, begin, end)
    ids = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    text, start, length, period = find(ids, first)
    size = np.diff(first)
    cover = np.zeros(len(ids) + 1, np.int64)
    np.add.at(cover, first[text] + start + period, 1)
    np.add.at(cover, first[text] + start + length, -1)
    kept = np.cumsum(cover)[:-1] == 0
    rows = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], fields=list(_RUN))
    runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(n + 1)).astype(np.int32)), rows)
    return K.batch(FOUND, doc_ids, size, runs, _joined(words, kept, np.repeat(np.arange(n), size), n))


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, at = K.text_bytes(b.column(1))
        for i, j in K.parts(at):
            yield _part(b.column(0).slice(i, j - i), data[at[i] : at[j]], at[i : j + 1] - at[i])


def find_runs(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs (start, length, period; by start, then period) and collapsed.

    ``collapsed`` has the words, joined by one space, without those that a run holds after its first period.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(K.tidy(_find), RESULT)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text; of about a tenth of the rows, by a checksum of doc_id, the words from some place on repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("long").cast("string"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), h.alias("h"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = rows.withColumn("w", F.when(F.expr("h % 10 = 0"), words)).withColumn("g", F.expr("h div 10")).withColumn("n", F.size("w"))
    rows = rows.withColumn("a", F.expr("if(n > 0, g % n, null)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    again = F.expr("array_join(transform(sequence(0L, n - 1L), i -> element_at(w, cast(1 + if(i >= a, a + (i - a) % p, i) as int))), ' ')")
    return rows.select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of the greatest length in periods (start, length, period, exponent_milli), runs_sha256, collapsed_sha256."""
    best = F.expr("aggregate(runs, cast(null as struct<start:bigint,length:bigint,period:bigint>), (m, r) -> if(m is null or r.length * m.period > m.length * r.period, r, m))")
    lines = F.expr("sha2(array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), ''), 256)")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), lines.alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "best.*", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
