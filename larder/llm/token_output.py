"""Token ids in Parquet: one row per document in ascending doc_id, ids as a list column.

Format. Below ``path``: ``part`` (the file's place in the order), ``doc_id``, ``local_start`` (ids before the document in its file),
``n_tokens`` and ``ids``. Ids are dictionary-encoded, or delta-encoded where a column chunk has too many distinct ones; row groups and
pages have set sizes, and the page indexes that Parquet writes let a reader skip to the pages of some documents. Counts and places are
columns of their own, so offsets are read without touching ids.

Defined cases: a null text is empty and holds the end id alone; a null doc_id comes last; documents with one doc_id are ordered by a
hash of their text, then by the text; very long texts are encoded whole; an empty table gives empty files; other
columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.llm import kernels as K

FILE = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])
DDL = "part int, doc_id long, local_start long, n_tokens long, ids array<int>"
OPTIONS = {
    "compression": "snappy", "parquet.writer.version": "v2", "parquet.block.size": str(32 << 20), "parquet.page.size": str(1 << 17), "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20), "parquet.page.row.count.limit": "2000",
}
#: Words, and runs, held with their ids by one worker, and words learnt in one call.
MOST, CALL = 400_000, 300
#: Text encoded at once, about: the more, the fewer times a word is looked up, and the more memory a worker takes beside the others.
BATCH_BYTES = 2 << 20
#: Characters whose words, lower case and normal form need no more than the pattern below: letters of the Latin script that lower
#: to one letter, digits, ASCII, and common punctuation. A text with any other one is given to the tokenizer whole.
_OTHER = "[^\t\n\r\x20-\x7e\u00a1\u00ab\u00bb\u00bf-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e\u2013\u2014\u2018-\u201d\u2026]"
# Fixed value: the words of the tokenizer's own pattern, for such texts in lower case.
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")


class Held:
    """Strings with their ids, looked up many at a time by sorted hashes, each hit compared with the string itself.

    Past ``MOST`` those met most often stay, half of what can be held at most.
    """

    def __init__(self) -> None:
        self.strings, self.flat, self.start, self.met = pa.array([], pa.string()), np.zeros(0, np.int32), np.zeros(1, np.int32), np.zeros(0, np.int32)
        self.hashes, self.places = np.zeros(0, K.U64), np.zeros(0, np.int32)

    @staticmethod
    def _hash(strings: pa.Array) -> np.ndarray:
        data, at = K.text_bytes(strings)
        out, full = np.zeros(len(strings), K.U64), np.flatnonzero(np.diff(at))
        out[full] = K.word_hashes(data, at[:-1][full], at[1:][full], lower=False)
        return out

    def find(self, strings: pa.Array) -> np.ndarray:
        """Places, -1 where a string isn't held."""
        out = np.full(len(strings), -1, np.int32)
        if len(self.hashes) and len(strings):
            h = self._hash(strings)
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = np.flatnonzero(self.hashes[at] == h)
            place = self.places[at[hit]]
            same = pc.equal(strings.take(pa.array(hit)), self.strings.take(pa.array(place))).to_numpy(zero_copy_only=False)
            out[hit[same]] = place[same]
            self.met[place[same]] += 1
        return out

    def add(self, strings: pa.Array, ids: np.ndarray, size: np.ndarray) -> None:
        h = self._hash(strings)
        order = np.argsort(h)
        at = np.searchsorted(self.hashes, h[order])
        self.hashes, self.places = np.insert(self.hashes, at, h[order]), np.insert(self.places, at, (len(self.met) + order).astype(np.int32))
        self.strings = pa.concat_arrays([self.strings, strings.cast(pa.string())])
        self.flat = np.concatenate((self.flat, ids))
        self.start = np.concatenate((self.start, (self.start[-1] + np.cumsum(size)).astype(np.int32)))
        self.met = np.concatenate((self.met, np.ones(len(size), np.int32)))

    def places_of(self, strings: pa.Array, learn) -> np.ndarray:
        """Places of all strings; ``learn`` gives ids and sizes of those that aren't held, which then are."""
        out = self.find(strings)
        new = np.flatnonzero(out < 0)
        if len(new):
            missing = strings.take(pa.array(new))
            ids, size = learn(missing)
            out[new] = len(self.met) + np.arange(len(new))
            self.add(missing, ids, size)
        return out

    def shrink(self) -> None:
        if len(self.met) <= MOST:
            return
        least = 2
        while (self.met >= least).sum() > MOST // 2:
            least *= 2
        keep = np.flatnonzero(self.met >= least)
        ids, size = gather(self.flat, self.start, keep)
        strings, met = self.strings.take(pa.array(keep)), self.met[keep] // 2
        self.__init__()
        self.add(strings, ids, size)
        self.met = met


def gather(flat: np.ndarray, start: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``flat`` at these places, one after another, and their sizes."""
    begin = start[at]
    size = start[at + 1] - begin
    shift = begin - (np.cumsum(size, dtype=np.int32) - size)  # what is held, and a batch, have far fewer than 2**31 ids
    return flat[np.arange(int(size.sum()), dtype=np.int32) + np.repeat(shift, size)], size


class WordEncoder:
    """Encodes texts by runs without white space, and those by words: merges never leave a word, so ids that were met once are held.

    New words are encoded many at a time, set apart by spaces; a word's last id is one that ends words.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.path = path
        self.learner = Tokenizer.from_file(path)  # for words that are cut and normal already
        self.special = "|".join(re.escape(t.content) for t in self.learner.get_added_tokens_decoder().values()) or r"[^\x00-\x{10FFFF}]"
        self.learner.normalizer = normalizers.Sequence([])
        self.learner.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.learner.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.words, self.runs = Held(), Held()

    @functools.cached_property
    def tokenizer(self):
        """The whole tokenizer; most workers never meet a text that needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _learn_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        text = words.to_pylist()
        ids = np.array(list(itertools.chain.from_iterable(self.learner.encode(" ".join(text[i : i + CALL]), add_special_tokens=False).ids for i in range(0, len(text), CALL))), np.int32)
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words):
            raise ValueError("this tokenizer does not end its words")
        return ids, np.diff(stops, prepend=0)

    def _learn_runs(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        # the pattern's words are letters, single digits and runs of others, but for what an apostrophe begins
        odd = pc.or_(pc.match_substring(runs, "'"), pc.equal(pc.utf8_trim_whitespace(runs), "")).to_numpy(zero_copy_only=False)
        order = np.concatenate((np.flatnonzero(~odd), np.flatnonzero(odd)))
        spaced = pc.utf8_trim_whitespace(pc.replace_substring_regex(runs.filter(pa.array(~odd)), r"([0-9]|[^\p{L}0-9]+)", r" \1 "))
        plain, others = pc.utf8_split_whitespace(spaced), [_WORD.findall(x) for x in runs.filter(pa.array(odd)).to_pylist()]
        n = np.concatenate((pc.list_value_length(plain).to_numpy(zero_copy_only=False).astype(np.int64), np.fromiter(map(len, others), np.int64, len(others))))
        words = pa.concat_arrays([plain.flatten(), pa.array(list(itertools.chain.from_iterable(others)), pa.string())]).dictionary_encode()
        self.words.shrink()
        at = self.words.places_of(words.dictionary, self._learn_words)[words.indices.to_numpy()]
        ids, size = gather(self.words.flat, self.words.start, at)
        size = K.sums(size, np.concatenate(([0], np.cumsum(n))))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return gather(ids, np.concatenate(([0], np.cumsum(size))).astype(np.int32), back)

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id, and the number of ids of each."""
        texts = texts.fill_null("")
        whole = pc.or_(pc.match_substring_regex(texts, _OTHER), pc.match_substring_regex(texts, self.special)).to_numpy(zero_copy_only=False)
        split = pc.utf8_split_whitespace(pc.utf8_lower(pc.if_else(pa.array(~whole), texts, "")))
        runs = split.flatten().dictionary_encode()
        self.runs.shrink()
        at = self.runs.places_of(runs.dictionary, self._learn_runs)[runs.indices.to_numpy()]
        ids, size = gather(self.runs.flat, self.runs.start, at)
        n_runs = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        own = K.sums(size, np.concatenate(([0], np.cumsum(n_runs))))
        if whole.any():
            apart = {int(i): np.array(self.tokenizer.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, np.int32) for i in np.flatnonzero(whole)}
            cut = np.concatenate(([0], np.cumsum(own)))
            ids = np.concatenate([apart.get(i, ids[cut[i] : cut[i + 1]]) for i in range(len(texts))])
            own[list(apart)] = [len(x) for x in apart.values()]
        # ids of all texts in their order, with an end id after each
        out = np.full(len(ids) + len(texts), end, np.int32)
        out[np.arange(len(ids), dtype=np.int32) + np.repeat(np.arange(len(texts), dtype=np.int32), own)] = ids
        return out, own + 1


_loaded: dict[str, WordEncoder] = {}


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together up to ``BATCH_BYTES``, about."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if held and sum(x.nbytes for x in held) + b.nbytes > BATCH_BYTES:
            yield pa.concat_batches(held)
            held = []
        held.append(b)
    if held:
        yield pa.concat_batches(held)


def _token_rows(batches: Iterator[pa.RecordBatch], tokenizer: str, end: int, part: int) -> Iterator[pa.RecordBatch]:
    """Rows of one file. What a batch leaves behind is given back before the next one."""
    if tokenizer not in _loaded:
        _loaded[tokenizer] = WordEncoder(tokenizer)
    before = 0
    for b in _joined(batches):
        _, at = K.text_bytes(b.column(1))
        for i, j in K.parts(at, BATCH_BYTES):
            ids, n = _loaded[tokenizer].encode(b.column(1).slice(i, j - i), end)
            K.release()
            start = before + np.cumsum(n) - n
            before += int(n.sum())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(ids, pa.int32()))
            out = K.batch(FILE, np.full(j - i, part, np.int32), b.column(0).slice(i, j - i), start, n, lists)
            for k in range(0, j - i, 1000):
                yield out.slice(k, 1000)


def write_tokens(docs: DataFrame, tokenizer: str, end: int, path: str) -> None:
    """Encodes every text and writes the files. ``tokenizer``: path of a tokenizers file on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        yield from _token_rows(batches, tokenizer, end, TaskContext.get().partitionId())

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    order: list[Column] = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc()]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    writer = dealt.mapInArrow(K.tidy(run), DDL).write
    for k, v in OPTIONS.items():
        writer = writer.option(k, v)
    writer.parquet(path)


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with ``start``; ids before each file come from the counts alone, a row for each file."""
    rows = spark.read.parquet(path)
    files = rows.groupBy(F.col("part").alias("file")).agg(F.sum("n_tokens").alias("n"))
    before = files.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    return rows.join(before, F.col("part") == F.col("file")).withColumn("start", F.col("local_start") + F.col("before"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and n_tokens of every document, without reading ids."""
    return _placed(spark, path).select("doc_id", "start", "n_tokens")


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids of every document, or of those from ``first`` to ``last``: the files are in order of doc_id, so
    readers skip row groups and pages by their indexes."""
    rows = _placed(spark, path).select("doc_id", "start", "n_tokens", "ids")
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    return rows if last is None else rows.where(F.col("doc_id") <= last)


def checksums(tokens: DataFrame) -> DataFrame:
    """ids_crc32 in place of ids: over each document's ids as little-endian unsigned 32-bit integers."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            at = lists.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4").view(np.uint8))  # the same bytes as unsigned
            yield K.batch(schema, b.column(0), b.column(1), np.diff(at), [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(K.tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long")
