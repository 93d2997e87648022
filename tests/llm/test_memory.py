"""What Python workers hold after a task: Spark reuses them, and what they keep stands beside the executor's heap from then on."""

import os
import random
import subprocess
import sys

import pytest
from tests.llm.test_brute_force import repeated

from tidemark.llm import line_dedup

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
PROGRAM = """
import re
import numpy as np, pyarrow as pa
from tidemark.llm import line_dedup, near_dedup, packed

def held():
    return int(re.search(r"\\nAnonymous:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024

def batches():  # 12 MB of lines of eight words
    for k in range(3):
        ids = np.random.default_rng(k).integers(0, 200_000, (4_000, 20, 8))
        texts = ["\\n".join(" ".join(f"w{w}" for w in line) for line in doc).encode() for doc in ids.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(range(4_000 * k, 4_000 * (k + 1)), pa.int64()), pa.array([0] * 4_000, pa.int64()), pa.array(texts, pa.binary()), pa.nulls(4_000, pa.list_(pa.int32()))], names=["doc_id", "tie", "text", "asks"])

rarity, groups = np.zeros(1 << line_dedup.RARITY_BITS, np.uint8), np.ones(1 << line_dedup.RARITY_BITS, np.uint32)
tasks = {
    "post": lambda: line_dedup._post(8, 80, rarity, groups, False),
    "sketch": lambda: near_dedup._sketch(5),
}
run = tasks[TASK]()
sum(b.num_rows for b in batches())
packed.give_back() if hasattr(packed, "give_back") else None
before = held()
rows = sum(b.num_rows for b in run(batches()))
print(rows, held() - before)
"""


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="needs Linux's memory figures")
@pytest.mark.parametrize("task", ["post", "sketch"])
def test_workers_give_back_what_they_used(task):
    done = subprocess.run([sys.executable, "-c", f"TASK = {task!r}\n{PROGRAM}"], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert not done.returncode, done.stderr
    rows, mb = done.stdout.split()
    assert int(rows) and float(mb) < 16


def test_line_dedup_of_small_slices(spark, monkeypatch):
    """Slices, strides of lists and messages move work, not results."""
    rng = random.Random(9)
    texts = {i: "\n".join(" ".join(f"w{rng.randrange(25)}" for _ in range(rng.randrange(12))) for _ in range(8)) for i in range(80)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for name, value in (("SLICE", 500), ("STRIDE", 8), ("SEND", 200)):
        monkeypatch.setattr(line_dedup, name, value)
    assert {r["doc_id"]: r["removed"] for r in line_dedup.repeated_lines(df).collect()} == repeated(texts)
