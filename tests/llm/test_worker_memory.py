"""Python workers outlive their tasks: what they keep, and how much text they take at once."""

import re

import numpy as np
import pyarrow as pa

from ratinglab.llm import hashing as H
from ratinglab.llm import jaccard, mixing, pieces, tiling


def held_mb():
    with open("/proc/self/smaps_rollup") as f:
        return int(re.search(r"\nPss_Anon:\s+(\d+)", f.read()).group(1)) / 1024


def test_free_memory_goes_back_when_a_task_ends():
    kept = []

    def run(batches):
        for b in batches:
            parts = [np.ones(10_000) for _ in range(2000)]  # 160 MB in pieces that are not mapped alone
            kept.append(parts[-1])  # the heap's top stays in use
            yield b
    before = held_mb()
    assert list(H.lean(run)([1])) == [1]
    assert held_mb() - before < 60
    assert len(kept) == 1


def test_row_functions_give_memory_back():
    for f in (jaccard._count_slots, jaccard._sets, jaccard._full_sets, jaccard._bound, jaccard._exact, tiling._found, tiling._kept, pieces._batches, mixing._count_words, mixing._score):
        assert hasattr(f, "__wrapped__")


def test_pieces_take_a_bounded_part_of_a_batch_at_once(monkeypatch):
    taken = []
    real = pieces.PieceModel.encode

    def encode(self, texts, check=True):
        taken.append(sum(len(t.encode()) for t in texts))
        return real(self, texts, check)
    monkeypatch.setattr(pieces.PieceModel, "encode", encode)
    texts = [f"word{i} " * 9000 for i in range(100)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(100), pa.int64()), "text": texts})
    rows = [r for out in pieces._batches([batch], pieces.default_model(), False, "digest") for r in out.to_pylist()]
    assert [r["doc_id"] for r in rows] == list(range(100)) and sum(taken) == sum(len(t) for t in texts)
    assert max(taken) <= pieces.TEXT_BYTES < 3 << 20
