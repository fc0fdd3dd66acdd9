"""Token counts of a byte-fallback piece vocabulary by a finite-state transducer.

The vocabulary is compiled, state by state as texts need them, into a deterministic transducer over characters. Greedy merging by
score has a local form: a sequence of pieces is the encoding of its text if each two neighbours are the encoding of theirs. So the
last piece of every prefix follows from the last pieces of shorter prefixes, no further back than the longest piece. A state holds the
longest suffix that begins some piece, with the last piece and the relative count at each of its places; a transition carries the
tokens that it adds (or takes back). Characters outside the vocabulary emit their bytes and reset the state.

No piece holds a space mark after another character, so each such place resets the state too. A chunk of text is therefore a map that
needs of its entry state only what stands before its first reset: (open head, tokens between resets, open tail). Maps compose
associatively; chunks of a long text are composed pairwise in a tree, as a parallel prefix scan does.

Defined cases: a null text counts as empty and has 0 tokens; repeated rows count each; other columns are ignored; an empty table gives an empty
table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm import kernels as K

MARK = "▁"
CHUNK = 1 << 14
LIMIT = 4096
OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
_RESET = re.compile(f"(?<=[^{MARK}])(?={MARK})")


class Transducer:
    """Compiled form of a piece vocabulary: ``pieces`` gives each piece's score, higher merging first."""

    #: States, transitions and words held at once; beyond it they are compiled anew, so memory stays bounded.
    MOST = 400_000

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        self.begins = {p[:i] for p in pieces for i in range(1, len(p))}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words = _Counts(self)
        self._clear()

    @classmethod
    def load(cls, path: str) -> Transducer:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = (i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))
        return cls({model.id_to_piece(i): model.get_score(i) for i in plain})

    def _clear(self) -> None:
        self.states: list[tuple] = [("", (None,), (0,))]
        self.ids: dict[tuple, int] = {self.states[0]: 0}
        self.moves: dict[tuple[int, str], tuple[int, int]] = {}

    def merge(self, text: str) -> list[str]:
        """Encoding of a short text by its definition; used to compile, not to count."""
        parts = list(text)
        while True:
            found = [(self.pieces[x], -i) for i in range(len(parts) - 1) if (x := parts[i] + parts[i + 1]) in self.pieces]
            if not found:
                return parts
            i = -max(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def fits(self, a: str, b: str) -> bool:
        """Whether a then b is the encoding of their text."""
        if (ok := self.pairs.get((a, b))) is None:
            ok = self.pairs[a, b] = self.merge(a + b) == [a, b]
        return ok

    def _compile(self, state: int, c: str) -> tuple[int, int]:
        if c not in self.pieces:
            return 0, len(c.encode())
        held, last, count = self.states[state]
        text = held + c
        for i in range(max(0, len(text) - self.longest), len(text)):
            piece = text[i:]
            if piece in self.pieces and (last[i] is None or self.fits(last[i], piece)):
                break
        added = count[i] + 1
        last, count = (*last, piece), tuple(x - added for x in (*count, added))
        keep = next((k for k in range(min(len(text), self.longest - 1), 0, -1) if text[-k:] in self.begins), 0)
        new = (text[len(text) - keep :], last[-keep - 1 :], count[-keep - 1 :])
        if new not in self.ids:
            self.ids[new] = len(self.states)
            self.states.append(new)
        return self.ids[new], added

    def run(self, segment: str) -> int:
        """Tokens of a text that follows a reset."""
        if len(self.moves) > self.MOST:
            self._clear()
        state = total = 0
        for c in segment:
            move = self.moves.get((state, c))
            if move is None:
                move = self.moves[state, c] = self._compile(state, c)
            state = move[0]
            total += move[1]
        return total

    def chunk(self, text: str) -> tuple[str, int | None, str]:
        """The map of a chunk (spaces already marks): open head, tokens between the first and last reset, open tail; None without a reset."""
        if MARK + MARK in text:
            head, *inner = _RESET.split(text)
            inner = [x[1:] if x[:1] == MARK and x[1:2] != MARK else MARK + x for x in inner]
            if not inner:
                return head, None, ""
            *inner, tail = inner
            done = sum(self.words[x] if x[:1] != MARK else self.run(x[1:]) for x in inner)
            return head, done, tail[1:] if tail[:1] == MARK else MARK + tail
        head, *inner = text.split(MARK)
        if not inner:
            return head, None, ""
        if head == "" and text:  # the chunk begins with a mark, which may follow another or not: it stays open
            head = MARK + inner.pop(0)
            if not inner:
                return head, None, ""
        *inner, tail = inner
        return head, sum(map(self.words.__getitem__, inner)), MARK + tail

    def compose(self, a: tuple, b: tuple) -> tuple:
        """The map of two chunks, one after the other."""
        if a[1] is None and b[1] is None:
            middle = self._open(a[0] + b[0])
            return middle
        if a[1] is None:
            x = self._open(a[0] + b[0])
            return (x[0], b[1], b[2]) if x[1] is None else (x[0], x[1] + self.run(x[2]) + b[1], b[2])
        x = self._open(a[2] + b[0])
        if b[1] is None:
            return (a[0], a[1], x[0]) if x[1] is None else (a[0], a[1] + self.run(x[0]) + x[1], x[2])
        return (a[0], a[1] + self.run(x[0]) + b[1], b[2]) if x[1] is None else (a[0], a[1] + self.run(x[0]) + x[1] + self.run(x[2]) + b[1], b[2])

    def _open(self, text: str) -> tuple:
        cut = [m.start() for m in _RESET.finditer(text)]
        if not cut:
            return text, None, ""
        at = [*cut, len(text)]
        return text[: cut[0]], sum(self.run(text[i:j]) for i, j in zip(at[:-2], at[1:-1], strict=True)), text[cut[-1] :]

    def count(self, text: str, size: int = CHUNK) -> int:
        """Tokens of a whole text, with the mark that stands before it."""
        if not text:
            return 0
        text = MARK + text.replace(" ", MARK)
        maps = [self.chunk(text[i : i + size]) for i in range(0, len(text), size)]
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        head, inner, tail = maps[0]
        return self.run(head) if inner is None else self.run(head) + inner + self.run(tail)


class _Counts(dict):
    """Tokens of a mark with the word after it; compiled when first asked for."""

    def __init__(self, owner: Transducer):
        super().__init__()
        self.owner = owner

    def __missing__(self, word: str) -> int:
        if len(self) >= Transducer.MOST:
            self.clear()
        n = self.owner.run(MARK + word)
        if len(word) <= 64:
            self[word] = n
        return n


_loaded: dict[str, Transducer] = {}


def count_tokens(docs: DataFrame, model: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document. ``model``: path of a piece model on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = _loaded.setdefault(model, None) or _loaded.__setitem__(model, Transducer.load(model)) or _loaded[model]
        for b in batches:
            data, at = K.text_bytes(b.column(1))
            raw, at = data.tobytes(), at.tolist()
            yield K.batch(OUT, b.column(0), [y - x for x, y in zip(at[:-1], at[1:], strict=True)], [fst.count(raw[x:y].decode()) for x, y in zip(at[:-1], at[1:], strict=True)])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
