"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text's symbols start as characters; the agenda holds every adjacent pair whose concatenation is
a piece, ordered by the piece's score (ties: leftmost). The best pair is merged, its neighbours
enter the agenda, until none is left. Symbols outside the vocabulary fall back to byte pieces.

No piece has a space mark after another character, so merges never cross the start of a run of
spaces. Texts are cut there, and each Arrow batch encodes its distinct chunks only once: chunks of
up to ``SHORT`` symbols step by step together in numpy (each step takes every chunk's best pair),
longer ones on a heap. The distinct chunks of each batch are checked against the sentencepiece
library; a difference is an error. Decoding joins the pieces' bytes.

Defined cases: null and empty texts give only the begin and end ids; U+2581 is a space, as in the
library; repeated rows are encoded alike; an empty table gives an empty result; a text of any
length is encoded whole; other columns are ignored by ``encoded`` and carried by ``with_ids``.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ratinglab.llm import hashing as H
from ratinglab.session import ship_package

SHORT = 48
TEXT_BYTES = 2 << 20  # texts encoded at once
SPACE = 0x20
NORMAL, UNKNOWN, BYTE = 1, 2, 6


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(raw: bytes):
    """(field number, value) of a protocol-buffer message."""
    i = 0

    def varint():
        nonlocal i
        shift = value = 0
        while True:
            c = raw[i]
            i += 1
            value |= (c & 127) << shift
            shift += 7
            if c < 128:
                return value
    while i < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, raw[i:i + n]
            i += n


class PieceModel:
    """Vocabulary, pair table and id tables of one model file."""

    _loaded: dict[str, "PieceModel"] = {}

    @classmethod
    def load(cls, path: str) -> "PieceModel":
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str):
        import sentencepiece
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        raw = [(f, v) for f, v in _fields(self.library.serialized_model_proto())]
        norm = dict(_fields(next(v for f, v in raw if f == 3)))
        trainer = dict(_fields(next(v for f, v in raw if f == 2)))
        if (trainer.get(3) != 2 or not trainer.get(35) or norm.get(2) or not norm.get(3, 1) or norm.get(4, 1)
                or not norm.get(5, 1)):
            raise ValueError("a merge-type model with byte fallback, identity normalisation and a leading space is needed")
        kinds, texts, scores = [], [], []
        for f, v in raw:
            if f == 1:
                d = dict(_fields(v))
                texts.append(d[1].decode())
                scores.append(np.frombuffer(d.get(2, b"\0" * 4), "<f4")[0])
                kinds.append(d.get(3, NORMAL))
        if set(kinds) - {NORMAL, UNKNOWN, 3, BYTE} or any("▁" in t.lstrip("▁") for t, k in zip(texts, kinds) if k == NORMAL):
            raise ValueError("user-defined or unused pieces, or a space mark inside a piece")
        ids = {t: i for i, (t, k) in enumerate(zip(texts, kinds)) if k == NORMAL}
        self.scores = np.array(scores, np.float64)
        self.bos, self.eos = self.library.bos_id(), self.library.eos_id()
        self.char_id = np.full(0x110000, -1, np.int32)
        pairs = {}
        for t, i in ids.items():
            if len(t) == 1:
                self.char_id[ord(t)] = i
            for k in range(1, len(t)):
                a, b = ids.get(t[:k]), ids.get(t[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = i
        self.char_id[SPACE] = self.char_id[0x2581]
        self.pairs = pairs
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ids = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int32)
        # rank: order of the agenda, best score first; equal scores share a rank
        order = np.unique(-self.scores)
        self.rank = np.searchsorted(order, -self.scores).astype(np.int32)
        self.byte_id = np.zeros(256, np.int32)
        out = []
        for i, (t, k) in enumerate(zip(texts, kinds)):
            if k == BYTE:
                self.byte_id[int(t[3:5], 16)] = i
                out.append(bytes([int(t[3:5], 16)]))
            else:
                out.append(t.replace("▁", " ").encode() if k == NORMAL else " ⁇ ".encode() if k == UNKNOWN else b"")
        self.out_bytes = np.frombuffer(b"".join(out), np.uint8)
        self.spaced = np.array([k == NORMAL and t[0] == "▁" for t, k in zip(texts, kinds)])
        self.out_len = np.array([len(x) for x in out], np.int64)
        self.out_start = np.concatenate([[0], np.cumsum(self.out_len)[:-1]])

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of the piece that joins each pair, -1 where there is none."""
        key = left.astype(np.int64) << 32 | (right.astype(np.int64) & 0xFFFFFFFF)
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (left >= 0) & (right >= 0), self.pair_ids[at], -1)

    def agenda(self, symbols: list[int]) -> list[int]:
        """Merge one chunk on a heap; negative symbols never merge."""
        left, right = list(range(-1, len(symbols) - 1)), list(range(1, len(symbols) + 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def add(a: int, b: int):
            if a >= 0 and b < len(symbols) and symbols[a] >= 0 and symbols[b] >= 0:
                m = self.pairs.get(symbols[a] << 32 | symbols[b])
                if m is not None:
                    heapq.heappush(heap, (int(self.rank[m]), a, symbols[a], symbols[b], b))
        gone = -(1 << 40)
        for a in range(len(symbols) - 1):
            add(a, a + 1)
        while heap:
            _, a, x, y, b = heapq.heappop(heap)
            if symbols[a] != x or symbols[b] != y or right[a] != b:
                continue
            symbols[a] = self.pairs[x << 32 | y]
            symbols[b] = gone
            right[a] = right[b]
            if right[b] < len(symbols):
                left[right[b]] = a
            add(left[a], a)
            add(a, right[a])
        return [s for s in symbols if s != gone]

    def _steps(self, sym: np.ndarray, chunk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge many short chunks together. sym: ids (negative: never merge); chunk: ascending."""
        far = np.int32(1 << 30)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        joint = np.append(np.where(chunk[1:] == chunk[:-1], self.merged(sym[:-1], sym[1:]), -1), -1)
        rank = np.where(joint >= 0, self.rank[joint], far)
        while len(sym):
            start = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1]))
            size = np.diff(np.append(start, len(sym)))
            best = np.minimum.reduceat(rank, start)
            live = best < far
            if not live.all():
                stay = np.repeat(live, size)
                done.append((sym[~stay], chunk[~stay]))
                sym, chunk, joint, rank = sym[stay], chunk[stay], joint[stay], rank[stay]
                start, size, best = None, size[live], best[live]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, size))
            at = hit[np.append(True, chunk[hit][1:] != chunk[hit][:-1])]  # leftmost of each chunk
            sym[at] = joint[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))  # one symbol fewer for each chunk before
            sym, chunk, joint, rank = sym[keep], chunk[keep], joint[keep], rank[keep]
            for p in (moved - 1, moved):
                p = p[(p >= 0) & (p < len(sym) - 1)]
                j = np.where(chunk[p] == chunk[p + 1], self.merged(sym[p], sym[p + 1]), -1)
                joint[p], rank[p] = j, np.where(j >= 0, self.rank[j], far)
            joint[-1], rank[-1] = -1, far
        if not done:
            return sym, chunk
        sym, chunk = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(chunk, kind="stable")
        return sym[order], chunk[order]

    def chunks(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each chunk (bytes in UTF-8, each begins with its spaces): flat ids, counts."""
        n = len(values)
        if not n:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        off = np.frombuffer(values.buffers()[1], np.int32)[values.offset:values.offset + n + 1]
        raw = np.frombuffer(values.buffers()[2], np.uint8)[off[0]:off[-1]]
        cps = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int32)
        lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        size = np.diff(lead[off - off[0]])
        chunk = np.repeat(np.arange(n), size)
        sym = self.char_id[cps]
        sym = np.where(sym < 0, -2 - cps, sym)
        short = np.repeat(size <= SHORT, size)
        out_sym, out_chunk = self._steps(sym[short], chunk[short])
        rest = np.flatnonzero(size > SHORT)
        if len(rest):
            first = np.cumsum(size) - size
            parts = [np.array(self.agenda(sym[first[c]:first[c] + size[c]].tolist()), np.int64) for c in rest]
            out_sym = np.concatenate([out_sym, *parts])
            out_chunk = np.concatenate([out_chunk, np.repeat(rest, [len(p) for p in parts])])
            order = np.argsort(out_chunk, kind="stable")
            out_sym, out_chunk = out_sym[order], out_chunk[order]
        if (out_sym < 0).any():  # byte fallback
            text = [bytes(chr(-2 - s), "utf-8") if s < 0 else b"\0" for s in out_sym.tolist()]
            count = np.array([len(t) for t in text])
            known = np.repeat(out_sym, count)
            spread = self.byte_id[np.frombuffer(b"".join(text), np.uint8)]
            out_chunk, out_sym = np.repeat(out_chunk, count), np.where(known < 0, spread, known)
        return out_sym.astype(np.int32), np.bincount(out_chunk, minlength=n)

    def check(self, values: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        """The library must give the same ids for every chunk. It adds the first space itself, but
        not to an empty text: a chunk of one space is that piece."""
        want = self.library.encode([v[1:].decode() for v in values.to_pylist()], num_threads=1)
        want = [w or [int(self.char_id[SPACE])] for w in want]
        flat = np.fromiter((i for w in want for i in w), np.int32, sum(map(len, want)))
        if not (np.array_equal(counts, [len(w) for w in want]) and np.array_equal(flat, ids)):
            raise AssertionError("the sentencepiece library encodes a chunk differently")

    def encode(self, texts: list[str | None], check: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of ids of each text, begin and end ids included."""
        raw = [b" " + t.replace("▁", " ").encode() if t else b"" for t in texts]
        size = np.array([len(r) for r in raw], np.int64)
        first = np.cumsum(size) - size
        data = np.frombuffer(b"".join(raw), np.uint8)
        begin = data == SPACE
        begin[1:] &= data[:-1] != SPACE
        begin[first[size > 0]] = True
        at = np.flatnonzero(begin)
        owner = np.searchsorted(first + size, at, side="right")
        array = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(
            np.append(at, len(data)).astype(np.int32)), pa.py_buffer(data)])
        coded = array.dictionary_encode()
        values, inverse = coded.dictionary, coded.indices.to_numpy()
        ids, counts = self.chunks(values)
        if check:
            self.check(values, ids, counts)
        begins = np.cumsum(counts) - counts
        total = counts[inverse]
        n = np.bincount(owner, weights=total, minlength=len(raw)).astype(np.int64) + 2
        flat = np.empty(int(n.sum()), np.int32)
        text_first = np.cumsum(n) - n
        body = np.ones(len(flat), bool)
        body[text_first] = body[text_first + n - 1] = False
        flat[text_first], flat[text_first + n - 1] = self.bos, self.eos
        within = np.arange(int(total.sum())) - np.repeat(np.cumsum(total) - total, total)
        flat[body] = ids[np.repeat(begins[inverse], total) + within]
        return flat, n

    def decode(self, flat: np.ndarray, n: np.ndarray) -> list[bytes]:
        """UTF-8 of the text of each id list."""
        size = self.out_len[flat]
        at = np.concatenate([[0], np.cumsum(size)])
        gather = np.repeat(self.out_start[flat] - at[:-1], size) + np.arange(at[-1])
        data = self.out_bytes[gather].tobytes()
        ends = np.cumsum(n)
        out = []
        for a, b in zip((ends - n).tolist(), ends.tolist()):
            text = data[at[a]:at[b]]
            head = next((i for i in range(a, b) if size[i]), None)  # control ids give no text
            text = text[1:] if head is not None and self.spaced[flat[head]] else text
            try:
                text.decode()
            except UnicodeDecodeError:
                text = text.decode("utf-8", "each_byte").encode()
            out.append(text)
        return out


codecs.register_error("each_byte", lambda e: ("�", e.start + 1))


@H.lean
def _batches(batches, path: str, check: bool, want: str):
    model = PieceModel.load(path)
    for part in (part for batch in batches for part in H.parts(batch, limit=TEXT_BYTES)):
        table = pa.Table.from_batches([part])
        flat, n = model.encode(table.column("text").to_pylist(), check)
        ends = np.cumsum(n)
        spans = list(zip((ends - n).tolist(), ends.tolist()))
        if want == "ids":
            ids = pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), flat)
            yield from table.append_column("piece_ids", ids).to_batches()
            continue
        little = flat.astype("<u4")
        yield pa.RecordBatch.from_pydict({
            "doc_id": table.column("doc_id").combine_chunks(), "n_tokens": n,
            "ids_sha256": [hashlib.sha256(little[a:b].tobytes()).hexdigest() for a, b in spans],
            "decoded_sha256": [hashlib.sha256(t).hexdigest() for t in model.decode(flat, n)]})


def encoded(df: DataFrame, path: str | None = None, check: bool = True) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of the text decoded from them."""
    ship_package(df.sparkSession)
    path = path or default_model()
    return df.select("doc_id", "text").mapInArrow(
        lambda b: _batches(b, path, check, "digest"),
        "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def with_ids(df: DataFrame, path: str | None = None, check: bool = True) -> DataFrame:
    """df with one more column ``piece_ids`` (a column of that name in df is replaced)."""
    ship_package(df.sparkSession)
    path = path or default_model()
    df = df.drop("piece_ids")
    schema = df.select("*", F.array(F.lit(0)).alias("piece_ids")).schema
    return df.mapInArrow(lambda b: _batches(b, path, check, "ids"), schema)


def query(spark, sf_dir):
    from ratinglab.llm.common import table
    return encoded(table(spark, sf_dir, "documents"))
