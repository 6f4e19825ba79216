"""Token counts of a unigram vocabulary by dynamic programming on a trie.

Texts are split at ASCII white space; a pre-token is a word with a space mark before it. Each Arrow
batch puts its distinct pre-tokens into a trie (sorted words: a node is the first word that has a
prefix) and computes the best score of a segmentation up to every node once, however many words
share the prefix: the maximum over the pieces that end there of the score before the piece plus
the piece's. Equal scores take fewer tokens. A word's terminal node stores its number of tokens
and score; a document's are sums over its words.

Pieces are those of a public vocabulary. It has merge ranks and no probabilities, so a piece's log
probability is that of Zipf's law for its rank; a character outside the vocabulary is one byte
token for each byte of its UTF-8.

Defined cases: null or empty texts have no tokens; repeated rows are counted alike; an empty table
gives an empty result; words longer than ``LONG`` characters are computed one by one, whole; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ratinglab.llm import hashing as H
from ratinglab.session import ship_package

LONG = 128
MARK = 0x2581
#: Scores are whole numbers of this part, so sums are exact in any order.
UNIT = 2.0 ** -20
_P = np.uint64(0x2545F4914F6CDD1D)


class Unigram:
    _loaded: dict[str, "Unigram"] = {}

    @classmethod
    def load(cls, path: str) -> "Unigram":
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        own = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        own.sort(key=lambda i: (-sp.get_score(i), i))
        total = sum(1 / (r + 1) for r in range(len(own) + 256))
        self.scores = {sp.id_to_piece(i): round(-np.log((r + 1) * total) / UNIT) for r, i in enumerate(own)}
        self.byte = round(-np.log((len(own) + 256) * total) / UNIT)
        self.longest = max(map(len, self.scores))
        keys = np.array([self._hash(p) for p in self.scores], np.uint64)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.array(list(self.scores.values()), np.int64)[order]
        self.power = np.cumprod(np.append(np.uint64(1), np.full(self.longest, _P)))

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_P) + int(H.mix(np.array([ord(c) + 1], np.uint64))[0])) % 2**64
        return h

    def word(self, w: str) -> tuple[int, int]:
        """(score, tokens) of one pre-token, the plain way."""
        best = [(0, 0)] + [None] * len(w)
        for j in range(1, len(w) + 1):
            n = len(w[j - 1].encode())
            options = [(best[j - 1][0] + n * self.byte, best[j - 1][1] - n)] if w[j - 1] not in self.scores else []
            for i in range(max(0, j - self.longest), j):
                if (v := self.scores.get(w[i:j])) is not None:
                    options.append((best[i][0] + v, best[i][1] - 1))
            best[j] = max(options)
        return best[-1][0], -best[-1][1]

    def trie(self, chars: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score, tokens) of sorted distinct words; chars: their code points, one after another."""
        n, first = len(size), np.cumsum(size) - size
        word = np.repeat(np.arange(n), size)
        depth = np.arange(len(chars)) - first[word]
        # a position is a node of its own unless the word before has the same prefix up to it
        has = (word > 0) & (depth < size[word - 1])
        same = np.zeros(len(chars), bool)
        same[has] = chars[first[word[has] - 1] + depth[has]] == chars[has]
        broken = np.where(same, np.int64(1 << 40), depth)
        shared = np.minimum.reduceat(broken, first)  # characters shared with the word before
        fresh = depth >= shared[word]
        # node of every position: the last fresh position of the same depth at or before it
        order = np.lexsort((word, depth))
        node = np.empty(len(chars), np.int64)
        node[order] = np.maximum.accumulate(np.where(fresh[order], np.arange(len(chars)), -1))
        node[order] = order[node[order]]
        # hashes of prefixes, then of the substrings that end at each node
        mixed = H.mix(chars.astype(np.uint64) + np.uint64(1))
        prefix = np.zeros(len(chars), np.uint64)
        by_depth = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[by_depth], np.arange(int(depth.max()) + 2))
        for d in range(len(cuts) - 1):
            at = by_depth[cuts[d]:cuts[d + 1]]
            prefix[at] = (prefix[at - 1] * _P if d else np.uint64(0)) + mixed[at]
        nodes = np.flatnonzero(fresh)
        nodes = nodes[np.argsort(depth[nodes], kind="stable")]
        deep = depth[nodes]
        bytes_of = 1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF)
        none = np.int64(-1 << 60)
        value = np.full((len(nodes), self.longest + 1), none)
        for k in range(1, self.longest + 1):
            ok = np.flatnonzero(deep + 1 >= k)
            at = nodes[ok]
            before = np.where(deep[ok] >= k, prefix[np.maximum(at - k, 0)], np.uint64(0))
            h = prefix[at] - before * self.power[k]
            pos = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            hit = self.keys[pos] == h
            value[ok[hit], k] = self.values[pos[hit]]
        score, count = np.zeros(len(chars), np.int64), np.zeros(len(chars), np.int64)
        levels = np.searchsorted(deep, np.arange(int(deep.max()) + 2))
        for d in range(len(levels) - 1):
            a, b = levels[d], levels[d + 1]
            at = nodes[a:b]
            best, fewest = np.full(b - a, none), np.zeros(b - a, np.int64)
            for k in range(0, min(d + 1, self.longest) + 1):
                back = max(k, 1)
                if k:
                    gain, used = value[a:b, k], np.int64(1)
                else:  # byte tokens where the character is no piece
                    gain = np.where(value[a:b, 1] == none, self.byte * bytes_of[at], none)
                    used = bytes_of[at]
                prev = node[at - back] if d >= back else None
                s = gain + (score[prev] if prev is not None else 0)
                c = used + (count[prev] if prev is not None else 0)
                better = (gain > none) & ((s > best) | ((s == best) & (c < fewest)))
                best, fewest = np.where(better, s, best), np.where(better, c, fewest)
            score[at], count[at] = best, fewest
        end = node[first + size - 1]  # terminal nodes
        return score[end], count[end]

    def words(self, values: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(score, tokens) of distinct words (without their space mark)."""
        score, count = np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
        order = sorted((i for i, v in enumerate(values) if len(v) < LONG), key=values.__getitem__)
        if order:
            text = "".join(["▁" + values[i] for i in order])
            chars = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
            score[order], count[order] = self.trie(chars, np.array([len(values[i]) + 1 for i in order], np.int64))
        for i, v in enumerate(values):
            if len(v) >= LONG:
                score[i], count[i] = self.word("▁" + v)
        return score, count


def _batches(batches, path: str):
    model = Unigram.load(path)
    for b in (part for batch in batches for part in H.parts(batch)):
        data, off = H.texts(b.column(1))
        s, e, owner = H.word_spans(data, off)
        n = b.num_rows
        size = e - s
        at = np.arange(int(size.sum())) + np.repeat(s - (np.cumsum(size) - size), size)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(
            np.concatenate([[0], np.cumsum(size)]).astype(np.int64)), pa.py_buffer(data[at])])
        coded = words.dictionary_encode()
        score, count = model.words([w.decode() for w in coded.dictionary.to_pylist()])
        inverse = coded.indices.to_numpy()
        add = lambda v: np.bincount(owner, weights=v[inverse], minlength=n) if len(s) else np.zeros(n)
        yield pa.RecordBatch.from_pydict({
            "doc_id": b.column(0), "n_words": pa.array(np.bincount(owner, minlength=n)[:n], pa.int64()),
            "n_tokens": pa.array(add(count).astype(np.int64)), "log_prob": pa.array(add(score) * UNIT)})


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens, log_prob (natural logarithm of the best segmentation)."""
    from ratinglab.llm.pieces import default_model
    ship_package(docs.sparkSession)
    path = path or default_model()
    return docs.select("doc_id", "text").mapInArrow(
        lambda b: _batches(b, path), "doc_id bigint, n_words bigint, n_tokens bigint, log_prob double")


def query(spark, sf_dir):
    from ratinglab.llm.common import table
    return token_counts(table(spark, sf_dir, "documents"))
