"""One conversation over many ranges: messages stand in the stated order wherever the ranges are cut."""

import random
from collections import defaultdict

import pytest

from larder.llm import chat


@pytest.fixture
def many_ranges(spark):
    keys = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "9"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("start", [chat.START, 4])
def test_one_turn_number_and_role_over_ranges(many_ranges, start, monkeypatch):
    monkeypatch.setattr(chat, "START", start)  # 4: many texts begin alike
    rnd = random.Random(3)
    text = lambda: "".join(rnd.choice("abé\U0001f600") for _ in range(rnd.randint(0, 9)))
    turns = [(1, 5, "user", text()) for _ in range(3000)] + [(1, None, "user", text()) for _ in range(500)] + [(2, 1, r, text()) for r in ("user", "system", None) for _ in range(50)]
    got = chat.render(many_ranges.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    by = defaultdict(list)
    for r in got:
        by[r.conv_id, r.perspective].append(r)
    assert {k: len(v) for k, v in by.items()} == {(1, "user"): 3500, (2, "user"): 150, (2, "unknown"): 150}
    for (conv, who), rows in by.items():
        rows.sort(key=lambda r: r.position)
        want = sorted(((t is None, t or 0, s or "unknown", x.encode()) for c, t, s, x in turns if c == conv))
        assert [r.position for r in rows] == list(range(len(want)))
        at = 0
        for r, (_, _, speaker, x) in zip(rows, want, strict=True):
            head = f"<|{'system' if speaker == 'system' else 'assistant' if speaker == who else 'user ' + speaker}|>\n"
            assert r.segment == head + x.decode() + "<|end|>\n" and (r.start, r.stop) == (at, at + len(r.segment))
            at = r.stop
            assert (r.mask_start, r.mask_stop) == ((r.start + len(head), r.stop) if speaker == who else (None, None))
