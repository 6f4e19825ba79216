"""Benchmark decontamination by greedy string tiling.

Tokens are runs of letters and digits in lower case. Every run of ``MIN_MATCH`` tokens that a
document shares with a test item is a seed (running Karp-Rabin hashes, then the tokens' own
hashes). Seeds on one diagonal form matches; the longest match is marked as a tile, again and
again, cut by what is marked already, until none of ``MIN_MATCH`` tokens is left. Tiles count in any
order, so reordered passages are found. A document is contaminated by an item if its tiles cover
at least ``COVERAGE`` of the item's tokens.

The test set is read in blocks of at most ``BLOCK_BYTES`` of text, each broadcast; documents pass
each block once, without a shuffle. Nothing depends on how often an item or a seed occurs.

Defined cases: null or empty texts have no tokens and match nothing; items of fewer than
``MIN_MATCH`` tokens are not distinctive and match nothing; a token or passage that repeats can be
covered once by each tile; repeated documents or items give repeated rows; empty tables give an
empty result (documents: unchanged); other columns are ignored by ``contaminations`` and carried
along by ``clean``.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ratinglab.llm import hashing as H
from ratinglab.session import ship_package

MIN_MATCH, COVERAGE = 5, 0.5
BLOCK_BYTES = 8 << 20
OUT = "doc_id bigint, item_id bigint, item_tokens bigint, covered bigint, n_tiles bigint, coverage double"


def _tokens(array: pa.Array):
    data, off = H.texts(pc.utf8_lower(array))
    s, e, owner = H.word_spans(data, off, H.LETTERS)
    return H.word_hashes(data, s, e), owner


class Block:
    """Seeds of a block of test items: sorted hashes, and where each occurs."""

    def __init__(self, ids: list, texts: list):
        self.ids = ids
        words, owner = _tokens(pa.array(texts, pa.string()))
        self.first = np.searchsorted(owner, np.arange(len(ids) + 1))
        self.words = words
        h = H.shingle_hashes(words, MIN_MATCH)
        inside = owner[:len(h)] == owner[MIN_MATCH - 1:][:len(h)] if len(h) else np.empty(0, bool)
        at = np.flatnonzero(inside)
        order = np.argsort(h[at], kind="stable")
        self.at, self.seeds = at[order], h[at][order]
        self.item = owner[self.at]
        self.bits = np.zeros(1 << 16, bool)
        self.bits[(self.seeds >> np.uint64(48)).astype(np.int64)] = True

    def tile(self, item: int, doc: np.ndarray, pairs: np.ndarray) -> tuple[int, int]:
        """(covered item tokens, tiles). pairs: (item position, document position) of the seeds."""
        a0 = self.first[item]
        a = self.words[a0:self.first[item + 1]]
        heap = []
        diagonals: dict[int, list[int]] = {}
        for i, j in pairs.tolist():
            if np.array_equal(a[i:i + MIN_MATCH], doc[j:j + MIN_MATCH]):
                diagonals.setdefault(j - i, []).append(i)
        for d, starts in diagonals.items():
            starts.sort()
            begin = last = starts[0]
            for i in starts[1:] + [1 << 60]:
                if i > last + 1:
                    heap.append((-(last + MIN_MATCH - begin), begin, d))
                    begin = i
                last = i
        heapq.heapify(heap)
        in_item, in_doc, covered, tiles = np.zeros(len(a), bool), set(), 0, 0
        while heap:
            size, i, d = heapq.heappop(heap)
            free = [k for k in range(i, i - size) if not in_item[k] and k + d not in in_doc]
            if len(free) == -size:
                in_item[i:i - size] = True
                in_doc.update(range(i + d, i + d - size))
                covered, tiles = covered - size, tiles + 1
                continue
            start = 0
            for k in range(1, len(free) + 1):  # what is left of it goes back
                if k == len(free) or free[k] != free[k - 1] + 1:
                    if k - start >= MIN_MATCH:
                        heapq.heappush(heap, (start - k, free[start], d))
                    start = k
        return covered, tiles

    def matches(self, array: pa.Array):
        """(text number, item, item tokens, covered, tiles) of every contaminated text."""
        data, off = H.texts(pc.utf8_lower(array))
        for a, b in H.slices(off):
            part, cut = data[off[a]:off[b]], off[a:b + 1] - off[a]
            s, e, owner = H.word_spans(part, cut, H.LETTERS)
            words = H.word_hashes(part, s, e)
            h = H.shingle_hashes(words, MIN_MATCH)
            at = np.flatnonzero(self.bits[(h >> np.uint64(48)).astype(np.int64)])
            at = at[owner[at] == owner[at + MIN_MATCH - 1]]
            low, high = np.searchsorted(self.seeds, h[at]), np.searchsorted(self.seeds, h[at], side="right")
            at, low, n = at[high > low], low[high > low], (high - low)[high > low]
            if not len(at):
                continue
            seed = np.repeat(low, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            where, item = np.repeat(at, n), self.item[seed]
            order = np.lexsort((where, item, owner[where]))
            where, item, seed = where[order], item[order], seed[order]
            doc = owner[where]
            start = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])))
            for x, y in zip(start, np.append(start[1:], len(doc))):
                d, i = int(doc[x]), int(item[x])
                size = int(self.first[i + 1] - self.first[i])
                pos = self.at[seed[x:y]] - self.first[i]
                seen = np.zeros(size + 1, np.int64)
                u = np.unique(pos)
                np.add.at(seen, u, 1)
                np.add.at(seen, u + MIN_MATCH, -1)
                if (np.cumsum(seen)[:size] > 0).sum() < COVERAGE * size:
                    continue  # even all seeds together cover too little
                d0 = np.searchsorted(owner, d)
                covered, tiles = self.tile(i, words[d0:np.searchsorted(owner, d + 1)], np.stack([pos, where[x:y] - d0], 1))
                if covered >= COVERAGE * size:
                    yield a + d, i, size, covered, tiles


def _blocks(bench: DataFrame):
    """Broadcast blocks of the test set; each has at most about BLOCK_BYTES of text."""
    b = bench.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    total = b.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // BLOCK_BYTES))
    for k in range(n if total else 0):
        part = b if n == 1 else b.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        rows = part.collect()
        if rows:
            yield bench.sparkSession.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows]))


@H.lean
def _found(batches, held):
    block = Block(*held.value)
    for b in batches:
        ids = b.column(0)
        rows = list(block.matches(b.column(1)))
        no = [r[0] for r in rows]
        yield pa.RecordBatch.from_pydict({
            "doc_id": ids.take(pa.array(no, pa.int64())), "item_id": pa.array([block.ids[r[1]] for r in rows], pa.int64()),
            "item_tokens": pa.array([r[2] for r in rows], pa.int64()), "covered": pa.array([r[3] for r in rows], pa.int64()),
            "n_tiles": pa.array([r[4] for r in rows], pa.int64()),
            "coverage": pa.array([r[3] / r[2] for r in rows], pa.float64())})


def contaminations(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """One row for each pair of a contaminated document and the item."""
    spark = docs.sparkSession
    ship_package(spark)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for held in _blocks(bench):
        one = d.mapInArrow(lambda batches, held=held: _found(batches, held), OUT)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], OUT)


@H.lean
def _kept(batches, held, text_at: int):
    block = Block(*held.value)
    for b in batches:
        keep = np.ones(b.num_rows, bool)
        keep[[r[0] for r in block.matches(b.column(text_at))]] = False
        yield b.filter(pa.array(keep))


def clean(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The rows of docs that no item contaminates, all columns as they are."""
    ship_package(docs.sparkSession)
    at = docs.columns.index("text")
    for held in _blocks(bench):
        docs = docs.mapInArrow(lambda batches, held=held: _kept(batches, held, at), docs.schema)
    return docs


def query(spark, sf_dir):
    from ratinglab.llm.common import table
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
