"""Quality rules: fixed base rules, then a calibrated logistic regression on hashed word and character n-grams.

Defined cases: a null or empty text has no words and fails the base rules; equal rows get equal verdicts; without labelled rows of
both kinds the base rules alone decide; other columns are ignored; every row of the input gives one row, a null ``doc_id`` too; very
long texts are judged whole; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm import kernels as K

BINS = 1 << 18
#: Most labelled rows that the classifier is fitted on; which ones follows from a hash of their id.
SAMPLE = 2000
#: Kept: calibrated probability of good quality of this at least.
THRESHOLD = 0.5
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("quality", pa.float64()), ("kept", pa.bool_())])
DDL = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality double, kept boolean"


@dataclass
class Model:
    """Weights of the hashed n-grams, and the line that turns a score into a probability."""

    weights: np.ndarray
    slope: float
    shift: float

    def probability(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * score + self.shift, -30, 30)))


def repeated(h: np.ndarray, first: np.ndarray, k: int = 8) -> np.ndarray:
    """For each text, its words in windows of k words that it holds twice or more."""
    window, start = K.shingles(h, first, k, short=False)
    if len(window) == 0:
        return np.zeros(len(first) - 1, np.int64)
    made = np.diff(start)
    key = window ^ K.mix(np.repeat(np.arange(1, len(made) + 1, dtype=K.U64), made))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = (np.arange(len(key)) + np.repeat(first[:-1] - start[:-1], made))[twice]
    step = np.bincount(at, minlength=len(h) + 1) - np.bincount(at + k, minlength=len(h) + 1)
    return K.sums(np.cumsum(step[:-1]) > 0, first)


def repeated_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = data.split(b"\n")
    if len(set(lines)) == len(lines):
        return 0
    seen, n = set(), 0
    for line in lines:
        if line in seen:
            n += bool(line.strip(b" \t\r\v\f"))
        seen.add(line)
    return n


def features(data: np.ndarray, offsets: np.ndarray, h: np.ndarray, first: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Families of n-grams, each as bins and the offsets of texts: words, word pairs, and 3 and 4 bytes."""
    low = K.LOWER[data].astype(np.uint32)
    out = [((h >> K.U64(46)).astype(np.int64), first)]
    pair, start = K.shingles(h, first, 2, short=False)
    out.append(((pair >> K.U64(46)).astype(np.int64), start))
    for k in (3, 4):
        made = np.maximum(np.diff(offsets) - k + 1, 0)
        start = np.concatenate(([0], np.cumsum(made)))
        at = np.arange(start[-1]) + np.repeat(offsets[:-1] - start[:-1], made)
        x = np.full(len(at), k, np.uint32)
        for j in range(k):
            x = x * np.uint32(0x9E3779B1) + low[at + j]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x85EBCA6B)
        out.append(((x >> np.uint32(14)).astype(np.int64), start))
    return out


def score(families: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, n: int) -> np.ndarray:
    """Sum over families of the mean weight of a text's n-grams."""
    total = np.full(n, float(weights[BINS]))
    for bins, start in families:
        c = np.concatenate(([0.0], np.cumsum(weights[bins], dtype=np.float64)))
        total += (c[start[1:]] - c[start[:-1]]) / np.maximum(np.diff(start), 1)
    return total


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse features of labelled rows, for the fit."""
    schema = pa.schema([("doc_id", pa.int64()), ("good", pa.int32()), ("bins", pa.list_(pa.int32())), ("shares", pa.list_(pa.float32()))])
    for b in batches:
        data, offsets = K.text_bytes(b.column(2))
        bins, shares = [], []
        for i in range(b.num_rows):
            own, at = data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]])
            begin, end, first = K.words(own, at)
            x = [np.concatenate(v) for v in zip(*((f, np.full(len(f), 1 / max(1, len(f)))) for f, _ in features(own, at, K.word_hashes(own, begin, end), first)), strict=True)]
            at, where = np.unique(x[0], return_inverse=True)
            bins.append(at)
            shares.append(np.bincount(where, x[1], len(at)))
        yield K.batch(schema, b.column(0), b.column(1), bins, shares)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fits the classifier on at most ``sample`` labelled rows; a fifth of them only calibrates. None without rows of both kinds."""
    labelled = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("good"))
    chosen = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = own.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "good")  # at most ``sample`` rows
    rows = rows.agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("doc_id", "good", "t.text")  # of an id's texts always the same one
    got = rows.mapInArrow(K.tidy(_rows), "doc_id long, good int, bins array<int>, shares array<float>").toArrow().sort_by("doc_id")
    good = got["good"].to_numpy().astype(float)
    if len(set(good.tolist())) < 2:
        return None
    shares = got["shares"].combine_chunks()
    start = shares.offsets.to_numpy().astype(np.int64)
    bins, shares = got["bins"].combine_chunks().flatten().to_numpy(), shares.flatten().to_numpy().astype(np.float64)
    row = np.repeat(np.arange(len(good)), np.diff(start))
    held = np.arange(len(good)) % 5 == 4
    if len(set(good[~held].tolist())) < 2 or len(set(good[held].tolist())) < 2:
        held[:] = False
    weight = np.where(good == 1, 0.5 / max(1, (good[~held] == 1).sum()), 0.5 / max(1, (good[~held] == 0).sum())) * ~held
    w, m, v = np.zeros(BINS + 1), np.zeros(BINS + 1), np.zeros(BINS + 1)

    def scores() -> np.ndarray:
        c = np.concatenate(([0.0], np.cumsum(w[bins] * shares)))
        return c[start[1:]] - c[start[:-1]] + w[BINS]

    for step in range(1, 81):  # Adam, whole sample each step
        error = (1 / (1 + np.exp(-np.clip(scores(), -30, 30))) - good) * weight
        grad = np.append(np.bincount(bins, shares * error[row], BINS), error.sum()) + 1e-7 * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w -= 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    at = held if held.any() else ~held
    s, y = scores()[at], good[at]
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    soft, slope, shift = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2)), 1.0, 0.0
    for _ in range(50):  # Newton steps of Platt's scaling
        p = 1 / (1 + np.exp(-np.clip(slope * s + shift, -30, 30)))
        d, r = p - soft, np.maximum(p * (1 - p), 1e-9)
        g, hess = np.array([(d * s).sum(), d.sum()]), np.array([[(r * s * s).sum() + 1e-6, (r * s).sum()], [(r * s).sum(), r.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        slope, shift = slope - step[0], shift - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return Model(w.astype(np.float32), float(slope), float(shift))


def assess(texts: pa.Array, model: Model | None, threshold: float = THRESHOLD) -> tuple[np.ndarray, ...]:
    """Columns of the verdict on a batch of texts: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, quality, kept."""
    all_data, all_at = K.text_bytes(texts)
    out = []
    for i, j in K.parts(all_at):
        data, at = all_data[all_at[i] : all_at[j]], all_at[i : j + 1] - all_at[i]
        begin, end, first = K.words(data, at)
        n = np.diff(first)
        chars = K.sums(((data & 0xC0) != 0x80) & K.BLACK[data], at)
        symbols = K.sums(SYMBOL[data], at)
        raw = data.tobytes()
        lines = np.array([repeated_lines(raw[x:y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], np.int64)
        again = repeated(K.word_hashes(data, begin, end, lower=False), first)
        failed = (n < 20) | (100 * again > 30 * n)
        p = np.full(j - i, 1.0) if model is None else model.probability(score(features(data, at, K.word_hashes(data, begin, end), first), model.weights, j - i))
        out.append((n, chars, symbols, lines, again, failed, p, ~failed & (p >= threshold)))
    if not out:
        return tuple(np.zeros(0, f.type.to_pandas_dtype()) for f in list(OUT)[1:])
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def judge(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: base counts, base verdict, calibrated quality and whether it is kept."""
    spread = docs.sparkSession.sparkContext.broadcast(model)  # 1 MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield K.batch(OUT, b.column(0), *assess(b.column(1), spread.value, threshold))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(K.tidy(run), DDL)


def keep(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all their columns, that ``judge`` keeps."""
    spread = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(assess(b.column(place).cast(pa.string()), spread.value, threshold)[-1]))

    return docs.mapInArrow(K.tidy(run), docs.schema)
