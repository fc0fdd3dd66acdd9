"""Exact substring dedup: every byte covered by a 100-byte string that starts earlier too is removed.

Candidates. Each string of ``LENGTH`` bytes has an anchor: the least hash among its ``GRAM``-byte pieces, leftmost if tied. Equal strings
have equal anchors, and neighbouring strings share theirs, so a text is a row of anchors, each with the run of starts that it stands
for and their context bytes. Anchors with one hash meet in one bucket. Runs with equal context are equal throughout: all but the
earliest are marked at once, in each task before the shuffle and in each bucket after it, so copies never gather.

Comparison. Where contexts differ round equal anchors, their bytes are fetched and a shard of them is put into a suffix array, by
Larsson-Sadakane refinement (ranks of prefixes doubled, only unfinished groups sorted again), with common prefixes by Kasai's
method, in step for all contexts. Suffixes that agree in ``LENGTH`` bytes stand together; all but the earliest are marked. An anchor with
very many contexts is dealt over several shards; each pair of those is merged by binary search of one's strings in the other's array.

Defined cases: a null text is empty; texts under ``LENGTH`` bytes lose nothing; earlier means smaller doc_id (null last), then, among
rows that share a doc_id, smaller hash of 32 bits of the text, then earlier start; rows equal in both are one document, each with its
result. Rows without doc_id are ordered and told apart by 64 bits of a text hash; they stand where doc_ids within 2**32 of the largest
long would, so no smaller doc_id comes after them. Other columns are ignored. Hashes of anchors and contexts have 64 bits each, and both must agree. Very
long texts are read whole; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm import kernels as K
from larder.llm.scratch import Scratch

LENGTH, GRAM = 100, 24
#: Input bytes for a bucket, about, where shuffle partitions are fewer; records held by a task; contexts of one anchor in a shard.
BUCKET_BYTES, HELD, SHARD = 64 << 20, 500_000, 4_000
#: Bytes of one suffix array, about.
ARRAY_BYTES = 1 << 19
FILTER_BITS = 1 << 24
NONE = np.iinfo(np.int64).max
RUN = np.dtype([("key", "<u8"), ("context", "<u8"), ("doc", "<i8"), ("text", "<u4"), ("at", "<u4"), ("back", "u1"), ("n", "u1")])
MARK = np.dtype([("doc", "<i8"), ("text", "<u4"), ("at", "<u4"), ("n", "<u4")])
WANT = np.dtype([("key", "<u8"), ("doc", "<i8"), ("text", "<u4"), ("at", "<u4"), ("n", "u1"), ("shards", "<u2")])
BLOB = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])
BLOB_DDL = "bucket int, kind int, blob binary"
RUNS, MARKS, WANTS = 0, 1, 2
_BYTE = K.seeds(256, 21)




def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of starts with one anchor: text, first start, distance to the anchor, number of starts; and a function for hashes."""
    n = len(data)
    if n < LENGTH:
        return (np.zeros(0, np.int64),) * 5
    up = K.powers(n + 1)
    total = np.concatenate((np.zeros(1, K.U64), np.cumsum(_BYTE[data] * up[:n], dtype=K.U64)))
    base = pow(int(up[1]), -1, 1 << 64)
    down = np.multiply.accumulate(np.concatenate((np.ones(1, K.U64), np.full(n, base, K.U64))))
    gram = K.mix((total[GRAM:] - total[: n - GRAM + 1]) * down[: n - GRAM + 1])
    least = (gram & K.U64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=K.U64)
    width, span = 1, LENGTH - GRAM + 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: n - LENGTH + 1], least[span - width :][: n - LENGTH + 1])
    anchor = (least & K.U64(0xFFFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
    start = np.flatnonzero(np.arange(len(anchor)) + LENGTH <= offsets[1:][text])
    if len(start) == 0:
        return (np.zeros(0, np.int64),) * 5
    anchor = anchor[start]
    new = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    first, q = start[new], anchor[new]
    size = np.diff(np.append(new, len(start)))
    context = K.mix((total[first + size - 1 + LENGTH] - total[first]) * down[first] + (q - first).astype(K.U64) * K.U64(0x9FB21C651E98DF25) + size.astype(K.U64) * K.U64(0xA24BAED4963EE407))
    return text[first], first, q - first, size, np.stack((gram[q], context))


def merge_marks(marks: np.ndarray) -> np.ndarray:
    """Joins neighbouring starts of one text."""
    if len(marks) == 0:
        return marks
    marks = marks[np.lexsort((marks["at"], marks["text"], marks["doc"]))]
    end = marks["at"].astype(np.int64) + marks["n"]
    new = np.concatenate(([True], (marks["doc"][1:] != marks["doc"][:-1]) | (marks["text"][1:] != marks["text"][:-1]) | (marks["at"][1:] > end[:-1])))
    at = np.flatnonzero(new)
    out = marks[at].copy()
    out["n"] = np.maximum.reduceat(end, at) - out["at"]
    return out


def _first_of_equals(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The earliest of runs with equal anchor and context, and marks of the others."""
    both = runs["key"] ^ K.mix(runs["context"].copy())
    order = np.argsort(both)
    both = both[order]
    same = np.zeros(len(both) + 1, bool)
    same[1:-1] = both[1:] == both[:-1]
    twin = same[1:] | same[:-1]
    alone, runs = runs[order[~twin]], runs[order[twin]]
    if len(runs) == 0:
        return alone, np.zeros(0, MARK)
    runs = runs[np.lexsort((runs["at"], runs["text"], runs["doc"], runs["context"], runs["key"]))]
    new = np.concatenate(([True], (runs["key"][1:] != runs["key"][:-1]) | (runs["context"][1:] != runs["context"][:-1])))
    # a repeated row, equal in doc_id, text and place, is the same start
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    same = (runs["doc"] == runs["doc"][lead]) & (runs["text"] == runs["text"][lead]) & (runs["at"] == runs["at"][lead])
    late = runs[~same]
    marks = np.zeros(len(late), MARK)
    for f in MARK.names:
        marks[f] = late[f]
    return np.concatenate((alone, runs[new])), merge_marks(marks)


def _bucket(doc: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    return (K.mix(doc.astype(np.int64).view(K.U64) ^ K.mix(text.astype(K.U64))) % K.U64(n)).astype(np.int64)


def _blobs(kind: int, rows: np.ndarray, bucket: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    """A row for each bucket that has any."""
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    used, start = np.unique(bucket, return_index=True)
    end = np.append(start[1:], len(rows))
    for i in range(0, len(used), 64):
        yield K.batch(BLOB, used[i : i + 64], [kind] * len(used[i : i + 64]), [rows[x:y].tobytes() for x, y in zip(start[i : i + 64], end[i : i + 64], strict=True)])


def _ids(column: pa.Array, hashes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """What tells rows apart: doc_id and 32 bits of the text's hash. Rows without doc_id take an id made of the other 32 bits, after all others."""
    low, high = (hashes.to_numpy().astype(np.int64) & 0xFFFFFFFF), (hashes.to_numpy().astype(np.int64) >> 32) & 0xFFFFFFFF
    doc = column.fill_null(NONE).to_numpy(zero_copy_only=False)
    return np.where(column.is_null().to_numpy(zero_copy_only=False), NONE - high, doc), low


def _find_runs(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            runs = np.concatenate(held) if held else np.zeros(0, RUN)
            held.clear()
            runs, marks = _first_of_equals(runs)
            yield from _blobs(RUNS, runs, (runs["key"] % K.U64(buckets)).astype(np.int64), buckets)
            yield from _blobs(MARKS, marks, _bucket(marks["doc"], marks["text"], buckets), buckets)

        for b in batches:
            doc, texts = _ids(b.column(0), b.column(1))
            all_data, all_at = K.text_bytes(b.column(2))
            for i, j in K.parts(all_at):
                at = all_at[i : j + 1] - all_at[i]
                text, first, back, size, pair = anchors(all_data[all_at[i] : all_at[j]], at)
                if len(first):
                    rows = np.zeros(len(first), RUN)
                    rows["key"], rows["context"] = pair
                    rows["doc"], rows["text"], rows["at"], rows["back"], rows["n"] = doc[i:j][text], texts[i:j][text].astype(np.uint32), first - at[text], back, size
                    held.append(rows)
                if sum(map(len, held)) > HELD:
                    yield from flush()
        yield from flush()

    return run


def _meet(buckets: int):
    """Of a bucket's runs: marks of equal ones, and wants for contexts that differ round one anchor."""

    def run(rows: pa.Table) -> pa.Table:
        kinds, blobs = rows["kind"].to_numpy(), rows["blob"].to_pylist()
        runs = np.concatenate([np.zeros(0, RUN)] + [np.frombuffer(x, RUN) for k, x in zip(kinds, blobs, strict=True) if k == RUNS])
        order = np.argsort(runs["key"])
        key = runs["key"][order]
        same = np.zeros(len(key) + 1, bool)
        same[1:-1] = key[1:] == key[:-1]
        runs, marks = _first_of_equals(runs[order[same[1:] | same[:-1]]])
        runs = runs[np.argsort(runs["key"], kind="stable")]
        _, where, count = np.unique(runs["key"], return_inverse=True, return_counts=True)
        often = count[where] > 1
        wants = np.zeros(int(often.sum()), WANT)
        for f in ("key", "doc", "text", "at", "n"):
            wants[f] = runs[f][often]
        wants["shards"] = np.minimum(-(-count[where][often] // SHARD), 65535)
        out = [pa.Table.from_batches([b]) for k, x in ((MARKS, marks), (WANTS, wants)) for b in _blobs(k, x, _bucket(x["doc"], x["text"], buckets), buckets)]
        return pa.concat_tables([*out, rows.filter(pa.array(kinds == MARKS)).select(BLOB.names).cast(BLOB)])

    return run


def _filter_bits(blobs: DataFrame, kind: np.dtype) -> np.ndarray:
    """A bit for each hash of a text that blobs of this kind name; 2 MB, whatever the input."""
    schema = pa.schema([("n", pa.int32()), ("bits", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS, bool)
        for b in batches:
            for x in b.column(0).to_pylist():
                rows = np.frombuffer(x, kind)
                bits[_bucket(rows["doc"], rows["text"], FILTER_BITS)] = True
        slices = np.packbits(bits, bitorder="little").reshape(-1, 4096)
        used = np.flatnonzero(slices.any(axis=1))
        yield K.batch(schema, used, [slices[i].tobytes() for i in used])

    out = np.zeros((FILTER_BITS // 8 // 4096, 4096), np.uint8)
    for n, bits in blobs.select("blob").mapInArrow(run, "n int, bits binary").groupBy("n").agg(F.bitmap_or_agg("bits")).collect():
        out[n] = np.frombuffer(bits, np.uint8)
    return np.unpackbits(out.ravel(), bitorder="little").astype(bool)


TEXT = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("hash", pa.int64()), ("text", pa.string()), ("n_bytes", pa.int64()), ("sha", pa.string())])
TEXT_DDL = "bucket int, doc_id long, hash long, text string, n_bytes long, sha string"


def _texts(rows: DataFrame, bits: np.ndarray, buckets: int, rest: bool) -> DataFrame:
    """Texts that the filter names, with their bucket; ``rest``: also the others, without text but with their digest."""
    spread = rows.sparkSession.sparkContext.broadcast(np.packbits(bits, bitorder="little"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = spread.value
        for b in batches:
            own = _ids(b.column(0), b.column(1))
            at = _bucket(*own, FILTER_BITS)
            named = bits[at // 8] >> (at % 8).astype(np.uint8) & 1 == 1
            bucket = _bucket(*own, buckets)
            data, at = K.text_bytes(b.column(2))
            raw = memoryview(data)
            sha = [None if x or not rest else hashlib.sha256(raw[i:j]).hexdigest() for x, i, j in zip(named, at[:-1].tolist(), at[1:].tolist(), strict=True)]
            text = pa.compute.if_else(pa.array(named), b.column(2).cast(pa.string()), pa.scalar(None, pa.string()))
            out = K.batch(TEXT, bucket, b.column(0), b.column(1), text, np.diff(at), sha)
            yield out if rest else out.filter(pa.array(named))

    return rows.mapInArrow(K.tidy(run), TEXT_DDL)


def _row_ids(texts: pa.Table) -> list[tuple[int, int]]:
    if not len(texts):
        return []
    doc, low = _ids(texts["doc_id"].combine_chunks(), texts["hash"].combine_chunks())
    return list(zip(doc.tolist(), low.tolist(), strict=True))


SHARDED = pa.schema([("bucket", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("wants", pa.binary()), ("bytes", pa.binary())])


def _contexts(buckets: int):
    """Context bytes of the wants of a bucket of texts, dealt by anchor."""

    def run(texts: pa.Table, blobs: pa.Table) -> pa.Table:
        wants = np.concatenate([np.zeros(0, WANT)] + [np.frombuffer(x, WANT) for x in blobs["blob"].to_pylist()])
        data, at = K.text_bytes(texts["text"])
        key = {x: n for n, x in enumerate(_row_ids(texts))}
        own = np.array([key.get((d, h), -1) for d, h in zip(wants["doc"].tolist(), wants["text"].tolist(), strict=True)], np.int64)
        wants, own = wants[own >= 0], own[own >= 0]
        begin = at[own] + wants["at"]
        size = wants["n"].astype(np.int64) - 1 + LENGTH
        shard = (wants["key"] % K.U64(buckets)).astype(np.int64)
        # an anchor of s shards: its context is in one of them, and meets each of the others in a pair
        s = np.maximum(wants["shards"], 1).astype(np.int64)
        block = (K.mix(wants["doc"].astype(np.int64).view(K.U64) ^ K.U64(77)) % s.astype(K.U64)).astype(np.int64)
        row = np.repeat(np.arange(len(wants)), s)
        other = np.arange(len(row)) - np.repeat(np.cumsum(s) - s, s)
        i, j = np.minimum(block[row], other), np.maximum(block[row], other)
        order = np.lexsort((j, i, shard[row]))
        row, i, j = row[order], i[order], j[order]
        place = np.stack((shard[row], i, j))
        new = np.flatnonzero(np.concatenate(([True], (place[:, 1:] != place[:, :-1]).any(axis=0)))) if len(row) else np.zeros(0, np.int64)
        ends = np.append(new[1:], len(row))
        raw = data.tobytes()
        out = [[], [], [], [], []]
        for x, y in zip(new.tolist(), ends.tolist(), strict=True):
            rows = row[x:y]
            for c, v in zip(out, (*place[:, x].tolist(), wants[rows].tobytes(), b"".join(raw[p : p + n] for p, n in zip(begin[rows].tolist(), size[rows].tolist(), strict=True))), strict=True):
                c.append(v)
        return pa.table([pa.array(c, f.type) for c, f in zip(out, SHARDED, strict=True)], schema=SHARDED)

    return run


def suffix_array(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of texts laid end to end (``ends``: where each stops), and ranks. A suffix stops with its text; equal ones keep the texts' order."""
    n = len(data)
    sizes = np.diff(np.concatenate(([0], ends)))
    stop = np.repeat(ends, sizes)
    left = np.minimum(stop - np.arange(n), 8)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    word = np.zeros(n, K.U64)
    for b in range(8):
        word |= np.where(b < left, padded[b : n + b], 0).astype(K.U64) << K.U64(8 * (7 - b))
    array = np.lexsort((left, word))
    new = np.concatenate(([True], (word[array[1:]] != word[array[:-1]]) | (left[array[1:]] != left[array[:-1]])))
    head = np.flatnonzero(new)[np.cumsum(new) - 1]  # a group's rank is where it begins
    rank = np.empty(n + 1, np.int64)
    rank[array], rank[n] = head, -1
    h = 8
    while h < sizes.max(initial=0):
        size = np.diff(np.append(np.flatnonzero(new), n))
        open_ = np.flatnonzero(np.repeat(size > 1, size))
        if len(open_) == 0:
            break
        at = array[open_]
        next_ = np.where(at + h < stop[at], rank[np.minimum(at + h, n)], -1)
        order = np.lexsort((next_, rank[at]))
        at, next_, own = at[order], next_[order], rank[at[order]]
        array[open_] = at
        new[open_] = np.concatenate(([True], (own[1:] != own[:-1]) | (next_[1:] != next_[:-1])))
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        rank[array[open_]] = head[open_]
        h *= 2
    return array, rank[:n]


def common_prefixes(data: np.ndarray, ends: np.ndarray, array: np.ndarray, limit: int = LENGTH) -> np.ndarray:
    """Kasai: bytes that each suffix shares with the one before it in the array, up to ``limit``; all texts advance in step."""
    n = len(data)
    before = np.empty(n, np.int64)
    before[array[1:]], before[array[0]] = array[:-1], -1
    starts = np.concatenate(([0], ends[:-1]))
    stop = np.append(np.repeat(ends, ends - starts), 0)
    out = np.zeros(n, np.int64)
    live, h = starts[starts < ends], np.zeros(len(starts), np.int64)[starts < ends]
    end = ends[starts < ends]
    while len(live):
        j = before[live]
        h = np.where(j < 0, 0, h)
        todo = np.flatnonzero(j >= 0)
        while len(todo):
            x, y = live[todo] + h[todo], j[todo] + h[todo]
            go = (h[todo] < limit) & (x < end[todo]) & (y < stop[j[todo]])
            go[go] = data[x[go]] == data[y[go]]
            todo = todo[go]
            h[todo] += 1
        out[live] = h
        h = np.maximum(h - 1, 0)
        live = live + 1
        keep = live < end
        live, h, end = live[keep], h[keep], end[keep]
    return out


def _late(group: np.ndarray, wants: np.ndarray, owner: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Marks of strings that are not the earliest of their group."""
    doc, text, at = wants["doc"][owner], wants["text"][owner], wants["at"][owner] + start
    order = np.lexsort((at, text, doc, group))
    new = np.concatenate(([True], group[order][1:] != group[order][:-1])) if len(order) else np.zeros(0, bool)
    lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else order
    late = order[(doc[order] != doc[lead]) | (text[order] != text[lead]) | (at[order] != at[lead])]
    marks = np.zeros(len(late), MARK)
    marks["doc"], marks["text"], marks["at"], marks["n"] = doc[late], text[late], at[late], 1
    return merge_marks(marks)


def _strings(wants: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For contexts laid end to end: where they end, and of each string its context, start in it and place."""
    n = wants["n"].astype(np.int64)
    size = n - 1 + LENGTH
    ends = np.cumsum(size)
    owner = np.repeat(np.arange(len(wants)), n)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    return ends, owner, start, (ends - size)[owner] + start


def _compare(wants: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Marks within one shard. Equal strings have one anchor, so anchors are taken a few at a time, in arrays of bounded size."""
    size = wants["n"].astype(np.int64) - 1 + LENGTH
    begin = np.cumsum(size) - size
    order = np.argsort(wants["key"], kind="stable")
    new = np.flatnonzero(np.concatenate(([True], wants["key"][order][1:] != wants["key"][order][:-1]))) if len(order) else np.zeros(0, np.int64)
    total = np.cumsum(size[order])
    out, i = [np.zeros(0, MARK)], 0
    while i < len(order):
        far = int(np.searchsorted(total, (total[i - 1] if i else 0) + ARRAY_BYTES, "right"))
        k = int(np.searchsorted(new, far, "right")) - 1  # the last anchor that begins by there, unless it is the first
        j = int(new[k]) if k >= 0 and new[k] > i else int(np.append(new, len(order))[np.searchsorted(new, i, "right")])
        j = len(order) if far >= len(order) else j
        own = order[i:j]
        at = np.arange(int(size[own].sum())) + np.repeat(begin[own] - (np.cumsum(size[own]) - size[own]), size[own])
        out.append(_compare_few(wants[own], data[at]))
        i = j
    return np.concatenate(out)


def _compare_few(wants: np.ndarray, data: np.ndarray) -> np.ndarray:
    ends, owner, start, place = _strings(wants)
    array, _ = suffix_array(data, ends)
    common = common_prefixes(data, ends, array)
    group = np.empty(len(data), np.int64)
    group[array] = np.cumsum(common[array] < LENGTH)
    return _late(group[place], wants, owner, start)


def _merge(wants: np.ndarray, data: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Marks between two shards: each string of the one is sought in the sorted strings of the other by binary search."""
    ends, owner, start, place = _strings(wants)
    view = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
    strings = np.ascontiguousarray(view[place]).view(f"S{LENGTH}").ravel()
    mine = left[owner]
    a, b = np.flatnonzero(mine), np.flatnonzero(~mine)
    a = a[np.argsort(strings[a], kind="stable")]
    known = strings[a]
    new = np.concatenate(([True], known[1:] != known[:-1]))
    group = np.full(len(owner), -1, np.int64)
    group[a] = np.cumsum(new) - 1
    first = np.searchsorted(known, strings[b])
    hit = first < len(known)
    hit[hit] = known[first[hit]] == strings[b][hit]
    group[b[hit]] = group[a[first[hit]]]
    both = group >= 0
    return _late(group[both], wants, owner[both], start[both])


def _shard_marks(buckets: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        wants = np.concatenate([np.frombuffer(x, WANT) for x in rows["wants"].to_pylist()])
        data = np.frombuffer(b"".join(rows["bytes"].to_pylist()), np.uint8)
        i, j = key[1].as_py(), key[2].as_py()
        if i == j:
            marks = _compare(wants, data)
        else:
            s = wants["shards"].astype(K.U64)
            left = (K.mix(wants["doc"].astype(np.int64).view(K.U64) ^ K.U64(77)) % s).astype(np.int64) == i
            marks = _merge(wants, data, left) if left.any() and not left.all() else np.zeros(0, MARK)
        return pa.concat_tables([BLOB.empty_table(), *(pa.Table.from_batches([b]) for b in _blobs(MARKS, marks, _bucket(marks["doc"], marks["text"], buckets), buckets))])

    return run


CUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
CUT_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def removed(marks: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes that marked strings cover."""
    begin, end = marks["at"].astype(np.int64), np.minimum(marks["at"].astype(np.int64) + marks["n"] - 1 + LENGTH, n)
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate(([True], begin[1:] > end[:-1]))) if len(begin) else np.zeros(0, np.int64)
    return begin[new], end[np.append(new[1:], len(begin)) - 1] if len(begin) else end


def _cut(texts: pa.Table, blobs: pa.Table) -> pa.Table:
    marks = merge_marks(np.concatenate([np.zeros(0, MARK)] + [np.frombuffer(x, MARK) for x in blobs["blob"].to_pylist()]))
    new = np.flatnonzero(np.concatenate(([True], (marks["doc"][1:] != marks["doc"][:-1]) | (marks["text"][1:] != marks["text"][:-1])))) if len(marks) else np.zeros(0, np.int64)
    own = {(int(marks["doc"][x]), int(marks["text"][x])): marks[x:y] for x, y in zip(new.tolist(), np.append(new[1:], len(marks)).tolist(), strict=True)}
    n, spans, digest = [], [], texts["sha"].to_pylist()
    data, at = K.text_bytes(texts["text"])
    for k, (d, h) in enumerate(_row_ids(texts)):
        raw = data[at[k] : at[k + 1]]
        begin, end = removed(own.get((d, h), marks[:0]), len(raw)) if digest[k] is None else ((), ())
        n.append(int(np.sum(end) - np.sum(begin)))
        spans.append(len(begin))
        if digest[k] is None:
            sha, last = hashlib.sha256(), 0
            for x, y in zip(begin, end, strict=True):
                sha.update(raw[last:x])
                last = y
            sha.update(raw[last:])
            digest[k] = sha.hexdigest()
    return pa.table([texts["doc_id"], texts["n_bytes"], pa.array(n, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())], schema=CUT)


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans and kept_sha256, the digest of the bytes that stay."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("hash"), text.alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // BUCKET_BYTES))
    runs = rows.mapInArrow(K.tidy(_find_runs(buckets)), BLOB_DDL)
    met = scratch.save(runs.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_meet(buckets), BLOB_DDL), "met")
    wants, marks = met.where(F.col("kind") == WANTS).select("bucket", "blob"), met.where(F.col("kind") == MARKS).select("bucket", "blob")
    texts = _texts(rows, _filter_bits(wants, WANT), buckets, rest=False)
    contexts = texts.groupBy("bucket").cogroup(wants.groupBy("bucket")).applyInArrow(_contexts(buckets), "bucket int, i int, j int, wants binary, bytes binary")
    more = scratch.save(contexts.groupBy("bucket", "i", "j").applyInArrow(_shard_marks(buckets), BLOB_DDL), "marks")
    marks = marks.union(more.select("bucket", "blob"))
    texts = _texts(rows, _filter_bits(marks, MARK), buckets, rest=True)
    return texts.groupBy("bucket").cogroup(marks.groupBy("bucket")).applyInArrow(_cut, CUT_DDL)
