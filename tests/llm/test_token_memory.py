"""What a worker of the token output takes, beside its loaded tokenizer, stays small whatever the text."""

import subprocess
import sys
from pathlib import Path

CODE = """
import resource, random
import pyarrow as pa, public_tokenizers
from larder.llm import token_output as T
path = public_tokenizers.path("word_bpe_49k.json")
T._loaded[path] = T.WordEncoder(path)
rnd = random.Random(1)
words = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(2, 9))) for _ in range(60000)]
def batches():
    for n in range(30):
        yield pa.record_batch([pa.array(range(500 * n, 500 * n + 500), pa.int64()), pa.array([" ".join(rnd.choices(words, k=300)) for _ in range(500)])], ["doc_id", "text"])
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024
before, n = peak(), 0
for b in (T._token_rows(batches(), path, 2, 0) if hasattr(T, "_token_rows") else ()):
    n += b.num_rows
print(n, peak() - before)
"""


def test_peak_of_a_worker():
    out = subprocess.run([sys.executable, "-c", CODE], capture_output=True, text=True, check=True, cwd=Path(__file__).resolve().parents[2])
    rows, grown = map(int, out.stdout.split()[-2:])
    assert rows == 15000 and grown < 100, grown
