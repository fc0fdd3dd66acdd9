"""Every operator against a brute-force version on a small fixture, with nulls, empty and long texts, ties, repeated rows and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from larder.llm import chat, decontam, fuzzy_passages, licenses, mixing, near_dup, quality, suffix_dedup, token_counts, token_output

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string, kept int, s string, words int, row int, size string, label string"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(text or "")


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    lexicon = ["".join(rnd.choice("abcdeéñÀK") for _ in range(rnd.randint(1, 7))) for _ in range(400)]
    text = lambda n: " ".join(rnd.choice(lexicon) + rnd.choice(["", "", ",", ".", "\n"]) for _ in range(n))
    base = [text(n) for n in (80, 120, 200, 60, 300)]

    def edit(t, share):
        w = t.split(" ")
        return " ".join(rnd.choice(lexicon) if rnd.random() < share else x for x in w)

    passage = text(70)
    texts = [None, "", " \n\t ", "one", "two words", "a b c d e", *base, *base[:2], base[0], *(edit(b, s) for b in base for s in (0.01, 0.03, 0.06, 0.1)), *(text(rnd.randint(1, 150)) for _ in range(25))]
    texts += [text(30) + " " + passage + " " + text(25), passage + " " + text(40), edit(passage, 0.03) + " " + text(60)]
    texts += ["x" * 5000, "ab " * 900, text(4000), "same line\n" * 40, "Licensed under the MIT License.\n" + text(30), text(9) + "\nLicensed under CC BY-NC 4.0.\n", "under the mit license apache license version 2 cc by nc", "Kelvin mit"]
    out = [(i, t, "xx", ["src1", "src2", "ünder", None][i % 4], None, "h", 1, "s", 2, 3, "z", "l") for i, t in enumerate(texts)]
    return [*out, out[7], (None, base[1], None, None, None, None, None, None, None, None, None, None), (None, text(40), "xx", "src1", 3, None, 0, "", 0, 0, "", "")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_licenses(docs, rows, empty):
    got = Counter(tuple(r) for r in licenses.scan(docs).collect())
    assert licenses.scan(empty).collect() == []
    assert sum(got.values()) == len(rows)
    plain = Counter()
    templates = {n: set(t.split()) for n, t in licenses.TEMPLATES.items()}
    for doc_id, text, *_ in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
        at = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        labels, score = {label for _, label in at}, 1.0 if at else 0.0
        for n, t in templates.items():
            wide = licenses.width(licenses.TEMPLATES[n])
            for i in range(0, max(len(w) - wide // 2, 1), wide // 2):
                held = set(w[i : i + wide])
                share = len(t & held) / len(t)
                must, bars = licenses.TELLING.get(n, ((), ()))
                if not held.issuperset(must) or held & set(bars):
                    continue
                if share >= (licenses.THRESHOLD if len(t) >= licenses.SHORT else 1):
                    labels.add(n.removesuffix("-line"))
                    score = max(score, share)
        starts = [i for i, _ in at]
        plain[doc_id, len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at})), ",".join(sorted(labels)), score] += 1
    assert got == plain


def test_near_duplicates(docs, rows, empty):
    got = Counter(tuple(r) for r in near_dup.near_duplicates(docs).collect())
    assert near_dup.near_duplicates(empty).collect() == [] and near_dup.keep_one(empty).collect() == []
    sets = []
    for _, text, *_ in rows:
        w = words(low(text))
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(1, len(w))))})
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[root(i)] = root(j)
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        ids[root(i)].append(r[0])
    plain = Counter()
    for i, r in enumerate(rows):
        component = min((x for x in ids[root(i)] if x is not None), default=None) if sets[i] else r[0]
        plain[r[0], len(sets[i]), component, r[0] == component] += 1
    assert got == plain
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns
    components = Counter(root(i) for i in range(len(rows)) if sets[i])
    assert kept.count() == len(components) + sum(not s for s in sets)


def test_blocks_of_a_large_cluster(spark, monkeypatch):
    """A cluster over many blocks gives the same components as one in a single block."""
    rnd = random.Random(1)
    base = [str(rnd.random()) for _ in range(60)]
    text = lambda: " ".join(w if rnd.random() > 0.02 else str(rnd.random()) for w in base)
    docs = spark.createDataFrame([(i, text()) for i in range(60)], "doc_id long, text string")
    want = sorted(tuple(r) for r in near_dup.near_duplicates(docs).collect())
    monkeypatch.setattr(near_dup, "BLOCK", 7)
    assert sorted(tuple(r) for r in near_dup.near_duplicates(docs).collect()) == want


def test_parts_of_a_cluster_that_blocks_do_not_join(spark, monkeypatch):
    """Loosely alike texts in small blocks: parts that single blocks and their leads leave apart are still compared with each other."""
    rnd = random.Random(11)
    base = [str(rnd.random()) for _ in range(80)]
    rows = []
    for i in range(70):
        share = (0.005, 0.02, 0.03, 0.05)[i % 4]
        rows.append((i, " ".join(w if rnd.random() > share else str(rnd.random()) for w in base)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [{tuple(t.split()[k : k + 5]) for k in range(76)} for _, t in rows]
    least = list(range(70))
    for _ in range(70):
        for i in range(70):
            for j in range(i):
                if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    least[i] = least[j] = min(least[i], least[j])
    monkeypatch.setattr(near_dup, "BLOCK", 3)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs).collect()}
    assert got == dict(enumerate(least)) and len(set(least)) > 3


def test_token_files_can_be_read_in_part(spark, docs, tmp_path):
    """Page indexes stand in the files, list columns are dictionary- or delta-encoded, and a range of documents is pushed to the reader."""
    import pyarrow.parquet as pq

    out = f"{tmp_path}/ids"
    token_output.write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), 2, f"file://{out}")
    files = [f for f in (tmp_path / "ids").glob("*.parquet") if pq.ParquetFile(f).metadata.num_rows]
    for f in files:
        group = pq.ParquetFile(f).metadata.row_group(0)
        columns = {group.column(i).path_in_schema.split(".")[0]: group.column(i) for i in range(group.num_columns)}
        assert all(c.has_offset_index and c.has_column_index for c in columns.values())
        assert set(columns["ids"].encodings) & {"RLE_DICTIONARY", "PLAIN_DICTIONARY", "DELTA_BINARY_PACKED"}
    some = token_output.read_tokens(spark, f"file://{out}", 5, 9)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,5)" in plan and "LessThanOrEqual(doc_id,9)" in plan
    whole = {(r.doc_id, r.start, tuple(r.ids)) for r in token_output.read_tokens(spark, f"file://{out}").collect()}
    assert {(r.doc_id, r.start, tuple(r.ids)) for r in some.collect()} == {x for x in whole if x[0] is not None and 5 <= x[0] <= 9}
    assert "ids" not in token_output.read_index(spark, f"file://{out}")._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_suffix_dedup(docs, rows, empty):
    got = Counter(tuple(r) for r in suffix_dedup.dedup_substrings(docs).collect())
    assert suffix_dedup.dedup_substrings(empty).collect() == []
    seen, plain = {}, Counter()
    # order of the definition: doc_id, null last; these fixtures' null rows have texts that differ
    order = sorted({(r[0] is None, r[0], r[1]) for r in rows}, key=lambda x: (x[0], x[1] or 0, hashlib.md5((x[2] or "").encode()).digest()))
    results = {}
    for _, doc_id, text in order:
        data = (text or "").encode()
        cover = np.zeros(len(data) + 1, int)
        for i in range(len(data) - 99):
            if seen.setdefault(data[i : i + 100], (doc_id, i)) != (doc_id, i):
                cover[i] += 1
                cover[i + 100] -= 1
        gone = np.cumsum(cover[:-1]) > 0
        spans = int((gone[1:] & ~gone[:-1]).sum() + (gone[:1].sum()))
        results[doc_id, text] = (len(data), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest())
    for r in rows:
        plain[(r[0], *results[r[0], r[1]])] += 1
    assert got == plain


def test_suffix_array_and_prefixes():
    rnd = np.random.default_rng(3)
    texts = [rnd.integers(0, 3, n).astype(np.uint8).tobytes() for n in (1, 7, 150, 170, 150)]
    texts.append(texts[2])
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    array, _ = suffix_dedup.suffix_array(data, ends)
    stop = {i: int(e) for s, e in zip([0, *ends[:-1]], ends, strict=True) for i in range(s, e)}
    suffix = [data[i : stop[i]].tobytes() for i in range(len(data))]
    assert [suffix[i] for i in array] == sorted(suffix)
    common = suffix_dedup.common_prefixes(data, ends, array)
    for a, b in zip(array[:-1], array[1:], strict=True):
        n = next((k for k, (x, y) in enumerate(zip(suffix[a], suffix[b], strict=False)) if x != y), min(len(suffix[a]), len(suffix[b])))
        assert common[b] == min(n, 100)


def test_anchor_in_several_shards(docs, monkeypatch):
    want = Counter(tuple(r) for r in suffix_dedup.dedup_substrings(docs).collect())
    monkeypatch.setattr(suffix_dedup, "SHARD", 2)
    monkeypatch.setattr(suffix_dedup, "ARRAY_BYTES", 300)
    assert Counter(tuple(r) for r in suffix_dedup.dedup_substrings(docs).collect()) == want


def test_passages(docs, rows, empty):
    got = fuzzy_passages.passages(docs).collect()
    assert fuzzy_passages.passages(empty).collect() == []
    text = {r[0]: words(low(r[1])) for r in rows if r[0] is not None}
    for r in got:
        if r.doc_id is not None and r.other_id is not None:
            assert r.other_id <= r.doc_id and r.stop - r.start >= 45 and r.identity >= 0.75
            a, b = text[r.doc_id][r.start : r.stop], text[r.other_id][r.other_start : r.other_stop]
            assert len(set(a) & set(b)) >= 0.6 * len(set(a))
    # every pair that shares a run of 60 words is joined, over other documents perhaps
    parent = {i: i for i in text}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in got:
        if r.doc_id is not None and r.other_id is not None:
            parent[root(r.doc_id)] = root(r.other_id)
    runs = defaultdict(set)
    for i, w in text.items():
        for k in range(len(w) - 59):
            runs[tuple(w[k : k + 60])].add(i)
    for found in runs.values():
        assert len({root(i) for i in found}) == 1
    touched = {i for r in got for i in (r.doc_id, r.other_id)}
    assert not touched & {r[0] for r in rows if r[0] is not None and len(text[r[0]]) < 50}


def test_chains_take_the_best_way():
    seg = np.array([[0, 10, 0, 10], [12, 20, 12, 8], [21, 40, 300, 9], [30, 45, 31, 15]])
    assert fuzzy_passages.chains(seg)[0] == [0, 1, 3]


def test_mixing(docs, rows, empty):
    got = mixing.mix(docs).collect()
    assert mixing.mix(empty).collect() == [] and mixing.mixed(empty).collect() == []
    size = [len(words(r[1])) for r in rows]
    total = Counter()
    for r, n in zip(rows, size, strict=True):
        total[r[3]] += n
    sources = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = dict(zip(sources, (5, 2, 1) * len(sources), strict=False))
    full: set = set()
    while True:
        level = (1.5 * sum(total.values()) - sum(2 * total[s] for s in full)) / sum(weight[s] for s in sources if s not in full)
        more = {s for s in sources if level * weight[s] >= 2 * total[s]}
        if more <= full:
            break
        full |= more
    target = {s: 2.0 * total[s] if s in full else level * weight[s] for s in sources}
    assert Counter((r.doc_id, r["size"], r.source_size) for r in got) == Counter((r[0], n, total[r[3]]) for r, n in zip(rows, size, strict=True))
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    largest = {s: max(n for r, n in zip(rows, size, strict=True) if r[3] == s) for s in sources}
    assert all(abs(taken[s] - target[s]) <= 2 * largest[s] for s in sources)
    again = mixing.mixed(docs)
    assert again.columns == docs.columns
    assert Counter(r.source for r in again.collect() for _ in words(r.text)) == taken
    assert sorted(map(str, mixing.mix(docs.repartition(5)).collect())) == sorted(map(str, got))


def test_decontamination(spark, docs, rows, empty):
    rnd = random.Random(2)
    w = words(rows[8][1])
    items = [(0, " ".join(w[20:50])), (1, None), (2, ""), (None, " ".join(w[:12])), (3, "two words"), (4, "nothing of this is there at all"), (5, " ".join(w[20:50]).upper())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    moved = words(rows[10][1])[:60]
    mixed = moved[40:] + moved[20:40] + moved[:20]
    more = docs.unionByName(spark.createDataFrame([(900, " ".join(mixed), *rows[0][2:])], SCHEMA))
    bench = bench.unionByName(spark.createDataFrame([(6, " ".join(moved))], "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(more, bench).collect()}
    assert (900, 6) in got and (10, 6) in got and (8, 0) in got and (8, None) in got and (4, 3) in got
    assert not {i for _, i in got} & {1, 2, 4}
    assert got == {(r.doc_id, r.item_id) for r in decontam.contaminated(more, bench, block_words=20).collect()}
    bad = {d for d, _ in got}
    kept = decontam.clean(more, bench)
    assert kept.columns == more.columns and {r.doc_id for r in kept.collect()} & bad <= {None}
    assert decontam.contaminated(empty, bench).collect() == [] and decontam.contaminated(docs, bench.limit(0)).collect() == []
    tiles = decontam.tile(np.array([5, 6, 7, 8, 9, 1, 2, 3, 4, 0], np.uint64), np.array([1, 2, 3, 4, 0, 5, 6, 7, 8, 9], np.uint64), 5)
    assert sorted(tiles) == [(0, 5, 5), (5, 0, 5)] and rnd


def test_token_output(spark, docs, rows, empty, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    out = f"file://{tmp_path}/ids"
    token_output.write_tokens(docs, path, 2, out)
    got = token_output.read_tokens(spark, out).orderBy("start").collect()
    at, want = 0, Counter()
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids[-1] == 2
        at += r.n_tokens
    ids = [r.doc_id for r in got]
    assert ids == sorted([i for i in ids if i is not None]) + [None] * ids.count(None)
    for doc_id, text, *_ in rows:
        want[doc_id, tuple([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2])] += 1
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    sums = {(r.doc_id, r.start): r.ids_crc32 for r in token_output.checksums(token_output.read_tokens(spark, out)).collect()}
    assert all(sums[r.doc_id, r.start] == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    assert {(r.doc_id, r.start, r.n_tokens) for r in token_output.read_index(spark, out).collect()} == {(r.doc_id, r.start, r.n_tokens) for r in got}
    token_output.write_tokens(empty, path, 2, out + "0")
    assert token_output.read_tokens(spark, out + "0").collect() == []


def test_word_encoder_is_exact_on_any_text(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, rnd = Tokenizer.from_file(path), random.Random(2)
    monkeypatch.setattr(token_output, "MOST", 300)
    encoder = token_output.WordEncoder(path)
    letters = [*"abcDEF's't  \n\t12_.-!ÀéñßŒſ²ªΣσ́中\U0001f600 \x1c\x85İKﬁ…“", "<|endoftext|>", "'ll", "'RE", "<|"]
    for latin in (letters, [*"abcDEF's't  \n\t12_.-!Àéñß…“", "'ll"]):
        texts = ["".join(rnd.choice(latin) for _ in range(rnd.randint(0, 25))) for _ in range(1500)]
        for i in range(0, len(texts), 50):
            ids, n = encoder.encode(pa.array(texts[i : i + 50], pa.string()), 2)
            want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts[i : i + 50]]
            assert n.tolist() == [len(x) + 1 for x in want] and ids.tolist() == [y for x in want for y in (*x, 2)]


def test_token_counts(docs, rows, empty):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    want = Counter()
    for doc_id, text, *_ in rows:
        n = len(model.encode(text or ""))
        want[doc_id, len((text or "").encode()), n, n > 4096] += 1
    assert Counter(tuple(r) for r in token_counts.count_tokens(docs, path).collect()) == want
    assert token_counts.count_tokens(empty, path).collect() == []
    fst, rnd = token_counts.Transducer.load(path), random.Random(1)
    for _ in range(3000):
        text = "".join(rnd.choice("aab  ehlorst▁\n\té<>中\U0001f600'., ") for _ in range(rnd.randint(0, 30)))
        assert {fst.count(text, size) for size in (1 << 14, 7, 3)} == {len(model.encode(text))}


def test_quality(spark, docs, rows, empty):
    labels = spark.createDataFrame([(i, int(len(words(rows[i][1])) > 30)) for i in range(40)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = quality.judge(docs, model).collect()
    want = Counter()
    for doc_id, text, *_ in rows:
        text = text or ""
        w = words(text)
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        repeats = len({j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)})
        lines = text.split("\n")
        again = sum(bool(words(x)) and x in lines[:i] for i, x in enumerate(lines))
        want[doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, repeats, len(w) < 20 or 100 * repeats > 30 * len(w)] += 1
    assert Counter(tuple(r)[:7] for r in got) == want
    assert all(r.kept == (not r.base_failed and r.quality >= quality.THRESHOLD) for r in got)
    assert Counter(r.doc_id for r in quality.keep(docs, model).collect()) == Counter(r.doc_id for r in got if r.kept)
    assert quality.judge(empty, model).collect() == [] and quality.fit(empty, labels) is None and quality.fit(docs, labels.limit(0)) is None
    assert all(r.kept == (not r.base_failed) for r in quality.judge(docs, None).collect())


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    rows = quality.judge(docs, model).join(labels.where("doc_id % 2 = 1").select("doc_id", labels["quality"].alias("good")), "doc_id").where("n_words >= 20").collect()
    assert np.mean([r.kept == bool(r.good) for r in rows if not r.base_failed or not r.good]) >= 0.95


def test_chat(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "a <|end|> b"), (1, 1, "assistant", "a <|end|> b"), (1, None, "bob", None), (2, 0, "system", "be kind"), (None, 5, None, "x"), (3, 0, "system", "s"), (3, 1, "user", "é")]
    df = spark.createDataFrame([(*t, 9, "n") for t in turns], "conv_id long, turn long, role string, text string, start int, name string")
    got = chat.render(df).collect()
    assert chat.render(df.limit(0)).collect() == []
    by = defaultdict(list)
    for r in got:
        by[r.conv_id, r.perspective].append(r)
    assert set(by) == {(1, "user"), (1, "assistant"), (1, "bob"), (2, None), (None, "unknown"), (3, "user")}
    for (conv, me), parts in by.items():
        parts.sort(key=lambda r: r.position)
        assert [r.position for r in parts] == list(range(len(parts))) and len(parts) == sum(t[0] == conv for t in turns)
        text = "".join(r.segment for r in parts)
        for r in parts:
            assert text[r.start : r.stop] == r.segment
            if r.role == "assistant":
                assert text[r.mask_start : r.mask_stop] == r.segment[r.segment.index("\n") + 1 :] and me is not None
            else:
                assert r.mask_start is None
    assert text.count("<|end|>") == len(parts)
    whole = sorted(by[1, "bob"], key=lambda r: r.position)
    assert [r.role for r in whole] == ["user", "user", "user", "assistant"] and whole[0].name == "user" and whole[1].segment == "<|user assistant|>\na < |end| > b<|end|>\n"
