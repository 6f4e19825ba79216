"""Cross-tokenizer alignment on inverted pair bitmaps.

Each text is encoded by a byte-level vocabulary (A, with a leading space) and by a piece vocabulary
(B, which adds that space itself). The byte offsets where tokens end cut the text: where both end,
a group ends; every stretch between neighbouring ends lies in exactly one A and one B token, and no
other stretch in the same two, so the stretches are the links (overlapping A-B occurrence pairs).

Documents are numbered within boxes of at most ``BOX_DOCS`` documents and about ``BOX_BYTES`` of text.
For every id pair a box keeps one posting: the compressed bitmap of the documents that hold the pair
(a sorted array of 16-bit numbers, or bits where that is shorter) and multiplicity planes, the same
kind of bitmap for each binary digit of (times in the document - 1). Postings of a box's slices of
text are OR-merged in its task. Popcounts of bitmaps give a pair's documents, those of the planes,
weighted by their digits, its links; sums over boxes give the corpus's. Then every posting takes its
pair's count, goes back to its box, and adds the count to the documents in its bitmap.

Shuffled are postings, two to three bytes for each distinct pair of a document. The pair table is
joined, not broadcast; the highest count of each B id (as many rows as the vocabulary) is broadcast.
A pair in every box is split by the skew join.

Defined cases: null and empty texts and texts whose tokens' bytes differ from space + text have no
tokens (zeros, and an empty string for the digest); special tokens' strings are plain text; repeated
rows are rows of their own; a null doc_id is kept; an empty table gives an empty result; other columns
are ignored.

A text is cut before every space that follows no white space: there both vocabularies begin a token
(A's words and B's pieces have a space at their beginning only), so groups and links never cross it.
Each slice of texts encodes and aligns its distinct chunks once; a text without spaces is one chunk.
"""

from __future__ import annotations

import hashlib
import itertools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ratinglab.llm import hashing as H
from ratinglab.llm.common import table, written
from ratinglab.session import ship_package

BOX_DOCS = 1 << 16
BOX_BYTES = 16 << 20
#: Text aligned at once, and chunks encoded at once.
SLICE_BYTES, RUN_BYTES = 4 << 20, 1 << 20
#: A pair is (A id << B_BITS | B id).
B_BITS = 20

_CODED = ("box bigint, slot int, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
          "pair bigint, docs binary, planes array<binary>, in_docs bigint, in_links bigint")
_OUT = ("doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")


def default_paths() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 characters
    are themselves, the other bytes follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(other)}


class Side:
    """Token bytes of one vocabulary, and its ids as text."""

    def __init__(self, tokens: list[bytes]):
        if len(tokens) > 1 << B_BITS:
            raise ValueError(f"more than {1 << B_BITS} tokens")
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        # an id and what follows it: nothing, the next id, the other vocabulary, the next group
        self.text = [f"{i}{after}" for i in range(len(tokens)) for after in ("", ",", "|", ";")]

    def joined(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        at = np.cumsum(size)
        return self.data[np.repeat(self.start[ids] - at + size, size) + np.arange(at[-1] if len(at) else 0)].tobytes()


class Aligner:
    """Both vocabularies, and the alignment of chunks."""

    _loaded: dict[tuple, "Aligner"] = {}

    @classmethod
    def load(cls, paths: tuple[str, str]) -> "Aligner":
        if paths not in cls._loaded:
            cls._loaded[paths] = cls(*paths)
        return cls._loaded[paths]

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = byte_letters()
        tokens = [b""] * self.a.get_vocab_size()
        for t, i in self.a.get_vocab().items():
            tokens[i] = bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode()
        pieces = [(self.b.id_to_piece(i), self.b.is_byte(i)) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p, _ in pieces):
            raise ValueError("a space mark inside a piece")
        self.sides = Side(tokens), Side([bytes([int(p[3:5], 16)]) if byte else p.replace("▁", " ").encode() for p, byte in pieces])
        self.text = self.sides[0].text + self.sides[1].text
        self.space = self.b.piece_to_id("▁")

    def encode(self, chunks: list[str]):
        """Flat ids and their numbers, of A and of B, for chunks that begin with a space."""
        a = [e.ids for e in getattr(self.a, "encode_batch_fast", self.a.encode_batch)(chunks, add_special_tokens=False)]
        # the library adds the first space, but not to an empty text
        b = [ids or [self.space] for ids in self.b.encode([c[1:] for c in chunks], num_threads=1)]
        for found in (a, b):
            count = np.fromiter(map(len, found), np.int64, len(found))
            yield np.fromiter(itertools.chain.from_iterable(found), np.int64, int(count.sum())), count

    def chunks(self, raw: list[bytes]) -> dict:
        """Of each chunk: whether its tokens give its bytes, numbers of A and B tokens, groups and
        links, the groups as text; and flat, the pairs of all links."""
        n, step = len(raw), 0
        chunks = [c.decode() for c in raw]
        size = np.cumsum([len(c) for c in raw])
        found = [], []
        while step < n:  # bounded runs: an encoding holds far more than its ids
            to = max(step + 1, int(np.searchsorted(size, (size[step - 1] if step else 0) + RUN_BYTES, side="right")))
            for mine, coded in zip(found, self.encode(chunks[step:to])):
                mine.append(coded)
            step = to
        out = {"good": np.ones(n, bool), "count": np.zeros((4, n), np.int64), "text": [""] * n, "pair": np.empty(0, np.int64)}
        if not n:
            return out
        found = [tuple(np.concatenate(x) for x in zip(*mine)) for mine in found]
        good, size = out["good"], np.array([len(c) for c in raw], np.int64)
        for side, (ids, count) in zip(self.sides, found):
            at = np.concatenate([[0], np.cumsum(side.size[ids])])[np.concatenate([[0], np.cumsum(count)])]
            joined = side.joined(ids)
            if not np.array_equal(np.diff(at), size) or joined != b"".join(raw):
                good &= np.array([joined[x:y] == c for x, y, c in zip(at[:-1].tolist(), at[1:].tolist(), raw)], bool)
        kept = np.flatnonzero(good)
        out = {"good": good, "count": np.zeros((4, n), np.int64), "text": [""] * n, "pair": np.empty(0, np.int64)}
        if not len(kept):
            return out
        ids, owner, ends = [], [], []
        for side, (flat, count) in zip(self.sides, found):
            ids.append(flat[np.repeat(good, count)])
            owner.append(np.repeat(kept, count[kept]))
            ends.append(np.cumsum(side.size[ids[-1]]))
        mark = np.zeros(int(ends[0][-1]) + 1, np.uint8)
        mark[ends[0]] = 1
        mark[ends[1]] |= 2
        at = mark[mark > 0]  # links in order: stretches between neighbouring ends
        is_end = (at & 1).astype(np.int64), (at >> 1).astype(np.int64)
        token = [np.cumsum(x) - x for x in is_end]  # the A and the B token of each link
        both = is_end[0] & is_end[1]
        group = np.cumsum(both) - both
        chunk = owner[0][token[0]]
        for j, x in enumerate((owner[0], owner[1], chunk[both > 0], chunk)):
            out["count"][j] = np.bincount(x, minlength=n)
        out["pair"] = ids[0][token[0]] << B_BITS | ids[1][token[1]]
        # ids of both in the order of groups, each with what follows it
        group = [group[e > 0] for e in is_end]
        inside = [np.bincount(g, minlength=int(both.sum())) for g in group]
        start = [np.cumsum(x) - x for x in inside]
        text = np.empty(len(ids[0]) + len(ids[1]), np.int64)
        for k, place in ((0, np.arange(len(ids[0])) + start[1][group[0]]), (1, np.arange(len(ids[1])) + (start[0] + inside[0])[group[1]])):
            after = np.where(np.append(group[k][1:] != group[k][:-1], True), 2 + k, 1)
            if k:  # nothing follows a chunk's last group
                after[np.append(owner[1][1:] != owner[1][:-1], True)] = 0
            text[place] = 4 * ids[k] + after + k * len(self.sides[0].text)
        words = list(map(self.text.__getitem__, text.tolist()))
        size = out["count"][0] + out["count"][1]
        for i, e in zip(kept.tolist(), np.cumsum(size)[kept].tolist()):
            out["text"][i] = "".join(words[e - size[i]:e])
        return out


def _space_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character before each place is white space (or, to be safe, a neighbour of such
    a character in its block)."""
    one, two, three = (data[np.maximum(at - j, 0)] for j in (1, 2, 3))
    return ((one <= 0x20) | (two == 0xC2) & ((one == 0x85) | (one == 0xA0)) | (three == 0xE1) & (two == 0x9A)
            | (three == 0xE2) & ((two == 0x80) | (two == 0x81)) | (three == 0xE3) & (two == 0x80))


def aligned(model: Aligner, texts: list[str]):
    """Numbers of A and B tokens, groups and links of each text (4 rows), the groups' digests, and
    of every link the text's number and the pair."""
    n = len(texts)
    raw = [b" " + t.encode() if t else b"" for t in texts]
    size = np.array([len(r) for r in raw], np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    begin = np.flatnonzero(data == 0x20)
    begin = begin[~_space_before(data, begin)]
    begin = np.union1d(begin, (np.cumsum(size) - size)[size > 0])
    owner = np.searchsorted(np.cumsum(size), begin, side="right")
    coded = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(
        np.append(begin, len(data)).astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
    found, which = model.chunks(coded.dictionary.to_pylist()), coded.indices.to_numpy()
    good = np.bincount(owner, weights=~found["good"][which], minlength=n) == 0
    owner, which = owner[good[owner]], which[good[owner]]
    counts = np.stack([np.bincount(owner, weights=c[which], minlength=n).astype(np.int64) for c in found["count"]])
    chunks = np.bincount(owner, minlength=n)
    digests, spelled = [], list(map(found["text"].__getitem__, which.tolist()))
    for e, m in zip(np.cumsum(chunks).tolist(), chunks.tolist()):
        digests.append(hashlib.sha256(";".join(spelled[e - m:e]).encode()).hexdigest() if m else "")
    links = found["count"][3]
    total = links[which]
    at = np.repeat((np.cumsum(links) - links)[which] - np.cumsum(total) + total, total) + np.arange(int(total.sum()))
    return counts, digests, np.repeat(owner, total), found["pair"][at]


# ------------------------------------------------------------------ compressed bitmaps

def bits_size(n_slots: int) -> int:
    """Bytes of a bitmap of bits; odd, as arrays of 16-bit numbers have an even size."""
    return (n_slots + 7) // 8 | 1


def bitmaps(count: np.ndarray, slots: np.ndarray, n_slots: int) -> pa.BinaryArray:
    """One compressed bitmap for each run of ``count`` ascending slots."""
    bits = bits_size(n_slots)
    dense = 2 * count > bits
    size = np.where(dense, bits, 2 * count)
    offset = np.concatenate([[0], np.cumsum(size)])
    if offset[-1] >= 1 << 31:
        raise ValueError("postings of a box over two gigabytes")
    data = np.zeros(int(offset[-1]), np.uint8)
    first = np.cumsum(count) - count
    thin = np.repeat(~dense, count)
    place = (np.repeat(offset[:-1] - 2 * first, count) + 2 * np.arange(len(slots)))[thin]
    data[place], data[place + 1] = slots[thin] & 255, slots[thin] >> 8
    for i in np.flatnonzero(dense):
        flags = np.zeros(8 * bits, np.uint8)
        flags[slots[first[i]:first[i] + count[i]]] = 1
        data[offset[i]:offset[i + 1]] = np.packbits(flags, bitorder="little")
    return pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(offset.astype(np.int32)), pa.py_buffer(data)])


def _raw(maps: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    offset = np.frombuffer(maps.buffers()[1], np.int32)[maps.offset:maps.offset + len(maps) + 1].astype(np.int64)
    data = maps.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), offset


def members(maps: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the bitmap, slot) of every set bit."""
    if not len(maps):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    data, offset = _raw(maps)
    size = np.diff(offset)
    thin = size % 2 == 0
    count = np.where(thin, size // 2, 0)
    at = np.repeat(offset[:-1] - 2 * (np.cumsum(count) - count), count) + 2 * np.arange(int(count.sum()))
    rows, slots = [np.repeat(np.arange(len(maps)), count)], [data[at].astype(np.int64) | data[at + 1].astype(np.int64) << 8]
    for i in np.flatnonzero(~thin):
        on = np.flatnonzero(np.unpackbits(data[offset[i]:offset[i + 1]], bitorder="little"))
        rows.append(np.full(len(on), i))
        slots.append(on)
    return np.concatenate(rows), np.concatenate(slots)


def popcounts(maps: pa.BinaryArray) -> np.ndarray:
    data, offset = _raw(maps)
    size = np.diff(offset)
    out = size // 2
    for i in np.flatnonzero(size % 2):
        out[i] = int(np.bitwise_count(data[offset[i]:offset[i + 1]]).sum())
    return out


def merged(parts: list[tuple[np.ndarray, np.ndarray]], n_slots: int) -> pa.Table:
    """Postings of a box from its slices' (pair << 16 | slot, times): bitmaps united, planes built,
    and both popcounted."""
    key, times = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[order]
    pair, slot = key >> 16, key & 0xFFFF
    begin = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    count = np.diff(np.append(begin, len(pair)))
    docs = bitmaps(count, slot, n_slots)
    more = np.flatnonzero(times > 1)
    row = np.repeat(np.arange(len(begin)), count)[more]
    extra = times[more] - 1
    depth = np.zeros(len(begin), np.int64)
    np.maximum.at(depth, row, np.frexp(extra.astype(float))[1])  # binary digits
    first = np.cumsum(depth) - depth
    digit = [np.flatnonzero(extra >> j & 1) for j in range(int(depth.max(initial=0)))]
    plane = np.concatenate([first[row[d]] + j for j, d in enumerate(digit)] or [np.empty(0, np.int64)])
    which = np.concatenate([slot[more][d] for d in digit] or [np.empty(0, np.int64)])
    order = np.lexsort((which, plane))
    planes = bitmaps(np.bincount(plane, minlength=int(depth.sum())), which[order], n_slots)
    weight = popcounts(planes) << (np.arange(int(depth.sum())) - np.repeat(first, depth))
    in_docs = popcounts(docs)
    in_links = in_docs + np.bincount(np.repeat(np.arange(len(begin)), depth), weights=weight, minlength=len(begin)).astype(np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(depth)]), pa.int32()), planes)
    return pa.table({"pair": pa.array(pair[begin]), "docs": docs, "planes": lists,
                     "in_docs": pa.array(in_docs), "in_links": pa.array(in_links)})


_KINDS = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary())}
_SCHEMA = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in _CODED.split(", ")])


def _whole(rows: pa.Table) -> pa.Table:
    return pa.table([rows.column(f.name).cast(f.type) if f.name in rows.column_names else pa.nulls(len(rows), f.type) for f in _SCHEMA],
                    schema=_SCHEMA)


def _code(batches, paths):
    """A row for every document, and for each box a row for every pair in it."""
    model = Aligner.load(paths)
    box = TaskContext.get().partitionId() << 32
    docs = size = 0
    parts: list[tuple[np.ndarray, np.ndarray]] = []

    def close():
        nonlocal parts, docs, size, box
        if parts:
            rows = merged(parts, docs)
            yield from _whole(rows.append_column("box", pa.array(np.full(len(rows), box)))).to_batches(max_chunksize=20000)
        parts, docs, size, box = [], 0, 0, box + 1
    for part in (part for batch in batches for some in H.parts(batch, limit=SLICE_BYTES) for part in
                 (some.slice(a, BOX_DOCS) for a in range(0, some.num_rows, BOX_DOCS))):
        n = part.num_rows
        if docs + n > BOX_DOCS or size > BOX_BYTES:
            yield from close()
        texts = [t or "" for t in part.column("text").to_pylist()]
        counts, digests, doc, pair = aligned(model, texts)
        if len(doc):
            parts.append(np.unique(pair << 16 | doc + docs, return_counts=True))
        yield from _whole(pa.table({
            "box": pa.array(np.full(n, box)), "slot": pa.array(np.arange(docs, docs + n), pa.int32()), "doc_id": part.column("doc_id"),
            **{c: pa.array(x) for c, x in zip(("n_a", "n_b", "n_groups", "n_links"), counts)}, "groups_sha256": pa.array(digests)})).to_batches()
        docs += n
        size += sum(map(len, texts))
    yield from close()


def _scored(docs: pa.Table, postings: pa.Table) -> pa.Table:
    """The documents of one box with what its postings return."""
    n = max(docs.column("slot").to_numpy().max(initial=-1) + 1, 0)
    best, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if len(postings):
        count, is_best = (postings.column(c).to_numpy() for c in ("count", "is_best"))
        postings = postings.combine_chunks()
        row, slot = members(postings.column("docs").chunk(0))
        np.add.at(total, slot, count[row])
        np.add.at(best, slot, is_best[row])
        planes = postings.column("planes").chunk(0)
        depth = pc.list_value_length(planes).to_numpy(zero_copy_only=False).astype(np.int64)
        parent = np.repeat(np.arange(len(depth)), depth)
        digit = np.arange(len(parent)) - np.repeat(np.cumsum(depth) - depth, depth)
        row, slot = members(planes.flatten())
        np.add.at(total, slot, count[parent[row]] << digit[row])
        np.add.at(best, slot, is_best[parent[row]] << digit[row])
    slot = docs.column("slot").to_numpy()
    out = docs.drop_columns(["box", "slot"])
    out = out.append_column("n_best", pa.array(best[slot])).append_column("count_sum", pa.array(total[slot]))
    return out.select([c.split()[0] for c in _OUT.split(", ")])


def coded(df: DataFrame, paths: tuple[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents with box, slot and their numbers; postings: box, pair, docs, planes, in_docs,
    in_links), written once."""
    ship_package(df.sparkSession)
    paths = paths or default_paths()
    rows = written(df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda b: _code(b, paths), _CODED), "align-postings")
    return (rows.where("pair IS NULL").select("box", "slot", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"),
            rows.where("pair IS NOT NULL").select("box", "pair", "docs", "planes", "in_docs", "in_links"))


def pair_counts(postings: DataFrame) -> DataFrame:
    """a_id, b_id, n_docs, n_links of every id pair linked anywhere, and whether n_links is the
    highest of its B id (``is_best``, ties included)."""
    b = F.col("pair").bitwiseAND((1 << B_BITS) - 1)
    pairs = postings.groupBy("pair").agg(F.sum("in_docs").alias("n_docs"), F.sum("in_links").alias("n_links"))
    pairs = written(pairs.select("pair", F.shiftright("pair", B_BITS).alias("a_id"), b.alias("b_id"), "n_docs", "n_links"), "align-pairs")
    top = pairs.groupBy("b_id").agg(F.max("n_links").alias("most"))  # a row for each B id at most
    return pairs.join(F.broadcast(top), "b_id").select("pair", "a_id", "b_id", "n_docs", "n_links",
                                                       (F.col("n_links") == F.col("most")).alias("is_best"))


def alignments(df: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    docs, postings = coded(df, paths)
    pairs = pair_counts(postings).select("pair", F.col("n_links").alias("count"), F.col("is_best").cast("long").alias("is_best"))
    scored = postings.select("box", "pair", "docs", "planes").join(pairs, "pair").select(F.col("box").alias("of"), "docs", "planes", "count", "is_best")
    return docs.groupBy("box").cogroup(scored.groupBy("of")).applyInArrow(_scored, _OUT)


def query(spark, sf_dir):
    return alignments(table(spark, sf_dir, "documents"))
