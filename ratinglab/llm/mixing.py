"""LM scoring by online logistic context mixing.

A text is coded as its tokens in lower case (A-Z), each word's bytes and a space, then an end
symbol. A byte is a path of binary decisions in a prefix code fitted to the training bytes that
follow the same two bytes (or the same one, where two are rare), so likely bytes take few. Four
predictors look at hashed contexts: the last four bytes of the word and all of the word so far,
each in all training texts and in those of one language. In a word's first ``HEAD`` symbols the
second one (all of the word, all texts) looks past the word's start, too: at the last ``BEFORE``
bytes of the word before, counted in the training texts themselves. Each holds, per context and tree node,
how often either branch was taken; its input is the log odds. Which language's predictors are
read follows the text's tokens so far: the language under which its frequent words were likeliest.
A mixer adds the inputs by weights of a gate, how often the word's beginning was seen in that
language, and learns from each coded bit (online, logistic loss). An adaptive probability map
refines its output, also bit by bit. The score is the sum of log10 of the final
probabilities: a proper code, decodable from what came before.

Weights and maps start anew every ``LANE_BITS`` coded bits at most, so a text of any length is
scored whole, in lanes of equal length side by side in numpy.

Corpus side: word counts are one pre-aggregated shuffle, whatever the corpus; tables are summed
from the distinct words, and what a word's start owes to the word before it from every slice's
distinct neighbours, added up in each task. Tables have a fixed number of
slots (``SLOT_BITS``), a broadcast of known size. Hot words, of at least one in ``HOT_SHARE`` of all
tokens (so at most that many), tell the language. The base score needs exact counts: those of hot and
of other frequent words (``LISTED`` in all, if fewer are hot) are broadcast, the others joined.

Defined cases: null and empty texts are the end symbol alone; a null doc_id is the text '' in the
hash; null and rarer languages are one group; repeated rows are scored alike; without training
texts every count is 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ratinglab.llm import hashing as H
from ratinglab.llm.common import written
from ratinglab.session import ship_package

FOLDS, HELD_OUT = 7, 2
HOT_SHARE = 1_000_000
LISTED = 1 << 19  # most words whose counts every task holds, unless more are hot
LANGUAGES = 4  # the most frequent ones; all others are one more group
GROUPS = LANGUAGES + 1
SLOT_BITS = (19, 21, 20, 21)  # of each predictor
PRIOR = (0.05, 0.02, 0.05, 0.02)  # added to both branches' counts
GATES = 4
HEAD, BEFORE = 4, 3  # a word's first symbols see so many last bytes of the word before
CODE_SHARE = 512  # two bytes have a code of their own from one in so many symbols on
LANE_BITS = 4096
SCORE_BYTES = 15 << 18  # texts scored side by side
STEPS_AT_ONCE = 32  # steps of the lanes that are laid out at once
PAIRS_AT_ONCE, HEADS_AT_ONCE = 1 << 12, 1 << 11  # words and heads whose bits are laid out at once
RATE, MAP_RATE, MAP_CELLS, MAP_STEP = 0.02, 0.02, 25, 0.5
PROBABILITY_FLOOR = 1e-5
#: Weights that the mixer starts from, by gate: unseen beginnings lean on short contexts.
START = np.array([[0.3, 0.0, 0.7, 0.0], [0.0, 0.1, 0.6, 0.3], [0.0, 0.1, 0.3, 0.6], [0.0, 0.05, 0.1, 0.85]], np.float32)
SPACE, END = 0x20, 0x0A
_U = np.uint64
_SALT = H.mix(np.arange(1, 9).astype(_U))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def _distinct(array: pa.Array):
    """Distinct words (binary, lower case), word number of every token, text number of every token."""
    data, off = H.texts(pc.ascii_lower(array))
    s, e, owner = H.word_spans(data, off)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(
        np.concatenate([[0], np.cumsum(e - s)]).astype(np.int64)), pa.py_buffer(data[H.NOT_SPACE[data]])])
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), owner


@H.lean
def _count_words(batches):
    """(text, held out, group) -> word, training tokens by group, all tokens; once for each batch."""
    names = [f"t{g}" for g in range(GROUPS)] + ["every"]
    for b in batches:
        tables = []
        for part in H.parts(b, limit=H.SLICE_BYTES):
            words, inverse, owner = _distinct(part.column("text"))
            train = ~part.column("held").to_numpy(zero_copy_only=False)[owner]
            group = part.column("grp").to_numpy()[owner]
            by = np.bincount(inverse[train] * GROUPS + group[train], minlength=len(words) * GROUPS).reshape(-1, GROUPS)
            tables.append(pa.table({"word": words.cast(pa.binary()), **{f"t{g}": by[:, g] for g in range(GROUPS)},
                                    "every": np.bincount(inverse, minlength=len(words))}))
        both = pa.concat_tables(tables).group_by("word").aggregate([(c, "sum") for c in names])
        yield from both.select(["word"] + [c + "_sum" for c in names]).rename_columns(["word"] + names).to_batches()
        del tables, both


def _raw(words: pa.Array):
    """(bytes, offsets) of a binary array."""
    off = np.frombuffer(words.buffers()[1], np.int64 if pa.types.is_large_binary(words.type) else np.int32)
    off = off[words.offset:words.offset + len(words) + 1].astype(np.int64)
    raw = np.frombuffer(words.buffers()[2], np.uint8)[off[0]:off[-1]] if off[-1] > off[0] else np.empty(0, np.uint8)
    return raw, off - off[0]


def _word_hash(words: pa.Array) -> np.ndarray:
    if not len(words):
        return np.empty(0, _U)
    raw, off = _raw(words)
    return H.word_hashes(raw, off[:-1], off[1:])


def _symbols(words: pa.Array):
    """(symbols, position in the word, first symbol of each word, symbols of each word): a word's
    bytes and a space; the end symbol is the word b"\\n" and has no space."""
    raw, off = _raw(words)
    last = off[1:] - off[:-1]
    closed = ~((last == 1) & (np.append(raw, 0)[off[:-1]] == END))
    size = last + closed
    first = np.cumsum(size) - size
    symbols = np.full(int(size.sum()), SPACE, np.uint8)
    inside = np.ones(len(symbols), bool)
    inside[(first + size - 1)[closed]] = False
    symbols[inside] = raw
    return symbols, np.arange(len(symbols)) - np.repeat(first, size), first, size


def _before(symbols: np.ndarray, pos: np.ndarray, k: int) -> np.ndarray:
    """The k-th symbol before each in its word, a space where there is none."""
    return np.where(pos >= k, symbols[np.maximum(np.arange(len(symbols)) - k, 0)], SPACE).astype(np.int64)


@H.lean
def _count_symbols(batches):
    """Training counts of (two symbols before, symbol), as key and number."""
    for b in batches:
        symbols, pos, _, size = _symbols(b.column(0))
        key = _before(symbols, pos, 2) << 16 | _before(symbols, pos, 1) << 8 | symbols
        used, which = np.unique(key, return_inverse=True)
        n = np.zeros(len(used), np.int64)
        np.add.at(n, which, np.repeat(b.column(1).to_numpy(), size))
        yield pa.RecordBatch.from_pydict({"key": pa.array(used, pa.int32()), "n": n})


def _tree(counts: np.ndarray) -> list[list[tuple[int, int]]]:
    """Huffman code of 256 symbols: the (node, branch) path of each."""
    heap = [(64 * int(c) + 1, s, s) for s, c in enumerate(counts)]
    heapq.heapify(heap)
    kids = []
    while len(heap) > 1:
        a = heapq.heappop(heap)
        b = heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], 256 + len(kids), 256 + len(kids)))
        kids.append((a[2], b[2]))
    paths: list = [None] * (256 + len(kids))
    paths[-1] = []
    for n in range(len(kids) - 1, -1, -1):
        for branch in (0, 1):
            paths[kids[n][branch]] = paths[256 + n] + [(n, branch)]
    return paths[:256]


class Code:
    """Prefix codes of the 256 bytes behind each byte, and behind pairs of bytes that are frequent."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        total = int(counts.sum())
        pair = np.bincount(keys >> 8, weights=counts, minlength=1 << 16)
        one = np.bincount(keys & 0xFFFF, weights=counts, minlength=1 << 16).reshape(256, 256)
        own = np.flatnonzero((pair > 0) & (pair * CODE_SHARE >= total))
        self.code_of = np.tile(np.arange(256), 256)
        self.code_of[own] = 256 + np.arange(len(own))
        used = sorted(set(np.flatnonzero(one.any(axis=1))) | {SPACE})
        spare = _tree(np.zeros(256, np.int64))
        trees = [spare] * 256
        for c in used:
            trees[c] = _tree(one[c])
        for c in own:
            at = (keys >> 8) == c
            trees.append(_tree(np.bincount(keys[at] & 0xFF, weights=counts[at], minlength=256)))
        flat: list = []
        starts, place = [], {}
        for t in trees:
            if id(t) not in place:
                place[id(t)] = len(starts), len(flat)
                flat.extend(step for path in t for step in path)
            starts.append(place[id(t)][1])
        self.size = np.array([[len(path) for path in t] for t in trees], np.int64)
        self.start = np.array(starts)[:, None] + np.cumsum(self.size, axis=1) - self.size
        self.node = np.array([n for n, _ in flat], np.int64)
        self.branch = np.array([b for _, b in flat], np.uint8)
        self.node_hash = (self.node + 1).astype(_U) * _SALT[7]

    def events(self, words: pa.Array, group: np.ndarray, tables=(0, 1, 2, 3), part: str = "whole"):
        """Every coded bit of words, or of their first ``HEAD`` symbols (part "head") or the others ("tail"): (sizes
        in bits, branches, hashes of each predictor's contexts for the words' groups)."""
        symbols, pos, first, size = _symbols(words)
        code = self.code_of[_before(symbols, pos, 2) << 8 | _before(symbols, pos, 1)]
        value = H._BYTES[symbols]
        total = np.concatenate([np.zeros(1, _U), np.cumsum(value * H.powers(int(pos.max(initial=0)) + 1)[pos])])
        some = np.flatnonzero({"whole": pos >= 0, "head": pos < HEAD, "tail": pos >= HEAD}[part])
        of = np.repeat(np.arange(len(words)), size)[some]
        back = lambda k: np.where(pos[some] >= k, value[np.maximum(some - k, 0)], _U(k))
        four = ((back(1) * H.BASE + back(2)) * H.BASE + back(3)) * H.BASE + back(4)
        whole = total[some] - total[first[of]]
        spoken = H.mix(group.astype(_U) + _U(1))[of]
        contexts = {0: lambda: four, 1: lambda: whole, 2: lambda: four + spoken, 3: lambda: whole + spoken}
        code, symbols = code[some], symbols[some]
        bits = self.size[code, symbols]
        at = np.repeat(np.arange(len(bits)), bits)  # the symbol of every bit
        which = (self.start[code, symbols] - (np.cumsum(bits) - bits)).take(at)
        which += np.arange(len(which))
        node = self.node_hash.take(which)
        keys = [(contexts[k]() + _SALT[k]).take(at) for k in tables]
        for key in keys:
            key += node
        return np.bincount(of, weights=bits, minlength=len(words)).astype(np.int64), self.branch.take(which), keys


def _slot(key: np.ndarray, table: int) -> np.ndarray:
    return (key * H.BASE >> _U(64 - SLOT_BITS[table])).view(np.int64)


def _endings(words: pa.Array) -> np.ndarray:
    """The last ``BEFORE`` bytes of each word (fewer in a shorter one) as one number; never 0."""
    raw, off = _raw(words)
    out = np.zeros(len(words), np.int64)
    for k in range(1, BEFORE + 1):
        there = np.flatnonzero(off[1:] - off[:-1] >= k)
        out[there] |= (raw[off[1:][there] - k].astype(np.int64) + 1) << (9 * (k - 1))
    return out


def _after(ending: np.ndarray) -> np.ndarray:
    """What predictor 1's context hashes are raised by behind a word of this ending; 0: none before."""
    return H.mix(ending.astype(_U) + _SALT[6])


def _tokens(words: pa.Array, inverse: np.ndarray, owner: np.ndarray, n: int):
    """The tokens of n texts, an end symbol (word number len(words)) behind each: (tokens but the ends in each
    text, places of the ends, word numbers, distinct endings, which of them the word before has)."""
    size = np.bincount(owner, minlength=n)
    ends = np.cumsum(size + 1) - 1
    token = np.full(len(inverse) + n, len(words), np.int64)
    body = np.ones(len(token), bool)
    body[ends] = False
    token[body] = inverse
    endings, which = np.unique(np.append(_endings(words), 0), return_inverse=True)  # 0: none before a text's first token
    before = np.zeros(len(token), np.int64)
    before[1:] = which[token[:-1]]
    return size, ends, token, endings, before


def _heads(words: pa.Array):
    """(place of a word for each distinct run of first ``HEAD`` symbols, which of these runs each word has)."""
    symbols, pos, first, size = _symbols(words)
    packed = np.zeros(len(words), np.int64)
    for k in range(HEAD):
        there = np.flatnonzero(size > k)
        packed[there] |= (symbols[first[there] + k].astype(np.int64) + 1) << (9 * k)
    return np.unique(packed, return_index=True, return_inverse=True)[1:]


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... size times, one after another."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


BLOCK_BITS = 16


def _blocks(tables: dict):
    """Branch counts by table, as blocks of slots that are not empty."""
    for k, t in tables.items():
        t = t.reshape(2, -1)
        for block in range(t.shape[1] >> BLOCK_BITS):
            part = t[:, block << BLOCK_BITS:(block + 1) << BLOCK_BITS]
            used = np.flatnonzero(part.any(axis=0))
            if len(used):
                yield pa.RecordBatch.from_pydict({
                    "table": pa.array([k], pa.int32()), "block": pa.array([block], pa.int32()),
                    "slots": pa.array([used.astype("<u2").tobytes()], pa.binary()),
                    "counts": pa.array([part[:, used].astype("<i8").tobytes()], pa.binary())})


@H.lean
def _count_heads(batches, held):
    """(text) of training rows: branch counts of predictor 1 in the words' first symbols, where its contexts
    hold the word before."""
    code = held.value
    table = np.zeros(2 << SLOT_BITS[1], np.int64)
    for part in (p for b in batches for p in H.parts(b, limit=H.SLICE_BYTES)):
        words, inverse, owner = _distinct(part.column("text"))
        _, _, token, endings, before = _tokens(words, inverse, owner, len(part))
        every = pa.concat_arrays([words.cast(pa.large_binary()), pa.array([b"\n"], pa.large_binary())])
        sample, head = _heads(every)
        pair, number = np.unique(head[token] * len(endings) + before, return_counts=True)
        after, head = _after(endings)[pair % len(endings)], pair // len(endings)
        for k in range(0, len(sample), HEADS_AT_ONCE):
            at = slice(*np.searchsorted(head, [k, k + HEADS_AT_ONCE]))
            some = every.take(pa.array(sample[k:k + HEADS_AT_ONCE]))
            size, branch, (key,) = code.events(some, np.zeros(len(some), np.int64), (1,), "head")
            n = size[head[at] - k]
            event = _spread((np.cumsum(size) - size)[head[at] - k], n)
            slot = _slot(key.take(event) + np.repeat(after[at], n), 1)
            np.add.at(table, slot + (branch.astype(np.int64) << SLOT_BITS[1]).take(event), np.repeat(number[at], n))
    yield from _blocks({1: table})


@H.lean
def _count_bits(batches, held):
    """Branch counts of the distinct words' contexts, as blocks of slots that are not empty; predictor 1's
    from behind the words' first symbols."""
    code = held.value
    tables = {k: np.zeros(2 << b, np.int64) for k, b in enumerate(SLOT_BITS)}

    def add(which, words, group, train, part="whole"):
        word_bits, branch, keys = code.events(words, group, which, part)
        weight = np.repeat(train, word_bits)
        for k, key in zip(which, keys):
            np.add.at(tables[k], _slot(key, k) + (branch.astype(np.int64) << SLOT_BITS[k]), weight)
    for b in batches:
        words, train = b.column(0), np.stack([b.column(g + 1).to_numpy() for g in range(GROUPS)], 1)
        none = np.zeros(len(words), np.int64)
        add((0,), words, none, train.sum(axis=1))
        add((1,), words, none, train.sum(axis=1), "tail")
        at, group = np.nonzero(train)
        add((2, 3), words.take(pa.array(at)), group, train[at, group])
    yield from _blocks(tables)


def _sum_blocks(table: pa.Table) -> pa.Table:
    """One block: log odds in units of 1/256 (int16), and for the gate how often it was seen."""
    k = table.column("table")[0].as_py()
    total = np.zeros((2, 1 << BLOCK_BITS))
    for slots, counts in zip(table.column("slots"), table.column("counts")):
        slots = np.frombuffer(slots.as_py(), "<u2").astype(np.int64)
        total[:, slots] += np.frombuffer(counts.as_py(), "<i8").reshape(2, -1)
    odds = np.log((total[1] + PRIOR[k]) / (total[0] + PRIOR[k]))
    odds = np.clip(np.round(odds * 256), -32767, 32767).astype("<i2")
    seen = np.minimum(np.floor(np.log2(total.sum(axis=0) + 1) / 3) + (total.sum(axis=0) > 0), GATES - 1).astype(np.uint8)
    return pa.table({"table": table.column("table")[:1], "block": table.column("block")[:1],
                     "odds": pa.array([odds.tobytes()], pa.binary()), "seen": pa.array([seen.tobytes()], pa.binary())},
                    pa.schema([("table", pa.int32()), ("block", pa.int32()), ("odds", pa.binary()), ("seen", pa.binary())]))


class Model:
    """What the scorer needs, all of bounded size: code, tables, frequent words and the two totals."""

    def __init__(self, code, odds, seen, hot, hot_counts, group_tokens, kinds, others=None, other_counts=()):
        self.code, self.odds, self.seen, self.kinds = code, odds, seen, kinds
        self.hot_counts = hot_counts  # a row of counts by group for each hot word
        # hot words, then other frequent ones, and the training tokens of each
        self.listed = hot if others is None else pa.concat_arrays([hot, others])
        self.counts = np.concatenate([hot_counts.sum(axis=1), np.asarray(other_counts, np.int64)])
        self.group_tokens, self.tokens = group_tokens, int(group_tokens.sum())
        h = _word_hash(self.listed)
        self.order = np.argsort(h, kind="stable").astype(np.int32)
        self.hash = h[self.order]
        if (self.hash[1:] == self.hash[:-1]).any():
            raise ValueError("two frequent words have one hash")

    def find(self, words: pa.Array):
        """Which words are listed (boolean array), and the places of those in the list."""
        if not len(self.listed):
            return np.zeros(len(words), bool), np.empty(0, np.int64)
        h = _word_hash(words)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.listed) - 1)
        found = self.hash[at] == h
        place = self.order[at]
        i = np.flatnonzero(found)
        found[i] = pc.equal(words.take(pa.array(i)), self.listed.take(pa.array(place[i]))).to_numpy(zero_copy_only=False)
        return found, place[found]

    def lanes(self, inputs, marks, stream, start, size) -> np.ndarray:
        """Natural log probability of every lane: ``size`` events of ``stream`` from ``start``.
        inputs: four int16 log odds of an event in eight bytes; marks: 2 * gate + branch."""
        order = np.argsort(-size, kind="stable")
        at, size = start[order], size[order]
        n, steps = len(size), int(size.max(initial=0))
        alive = np.searchsorted(-size, -np.arange(-(-steps // STEPS_AT_ONCE) * STEPS_AT_ONCE), side="left")
        # 16 bytes hold the four weights of a lane and gate, with their signs turned
        weights = np.tile((START / np.float32(-256)).reshape(-1), n).view(np.complex128)
        step = np.float32(RATE / 65536)
        half = MAP_CELLS // 2
        cells = (np.arange(MAP_CELLS) - half).astype(np.float32) * np.float32(MAP_STEP)
        maps = np.tile(1 / (1 + np.exp(-cells)), n).astype(np.float32)
        sums = total = np.zeros(n)
        own, place = np.arange(n) * GATES, np.arange(n) * MAP_CELLS
        low, high = np.float32(PROBABILITY_FLOOR), np.float32(1 - PROBABILITY_FLOOR)
        one, scale, middle, top = np.float32(1), np.float32(-1 / MAP_STEP), np.float32(half + 0.5), np.float32(MAP_CELLS - 0.5)
        rate, blend = np.float32(MAP_RATE), np.float32(0.5)
        for t in range(0, steps, STEPS_AT_ONCE):
            # what does not depend on the weights and maps is laid out for some steps at once; for lanes that end
            # among them it is not used
            m = alive[t]
            at, own, place, total = at[:m], own[:m], place[:m], total[:m]
            event = stream.take(at + np.arange(t, t + STEPS_AT_ONCE)[:, None], mode="clip").astype(np.int64)
            xs = inputs.take(event).view(np.int16).astype(np.float32)
            mark = marks.take(event)
            ys = (mark & 1).astype(np.float32)
            cells_of = (mark >> 1).astype(np.int64)
            cells_of += own
            dots, ps = np.zeros((STEPS_AT_ONCE, m), np.float32), np.ones((STEPS_AT_ONCE, m), np.float32)
            left = alive[t:t + STEPS_AT_ONCE].tolist()
            for j, m in enumerate(left):
                x, cell, dot, p = xs[j, :4 * m], cells_of[j, :m], dots[j, :m], ps[j, :m]
                w = weights.take(cell).view(np.float32)
                each = w * x
                np.add(each[0::4], each[1::4], out=dot)
                dot += each[2::4]
                dot += each[3::4]
                np.exp(dot, out=p)
                p += one
                np.reciprocal(p, out=p)
                gap = p - ys[j, :m]
                gap *= step
                x *= gap.repeat(4)
                w += x
                weights[cell] = w.view(np.complex128)
            # the weights do not depend on the maps
            dots *= scale
            dots += middle
            np.maximum(dots, blend, out=dots)
            np.minimum(dots, top, out=dots)
            cells_of = dots.astype(np.int64)
            cells_of += place
            for j, m in enumerate(left):
                cell = cells_of[j, :m]
                refined = maps.take(cell)
                ps[j, :m] += refined
                gap = ys[j, :m] - refined
                gap *= rate
                gap += refined
                maps[cell] = gap
            ps *= blend
            np.minimum(ps, high, out=ps)
            np.maximum(ps, low, out=ps)
            ps += ys
            ps -= one
            np.abs(ps, out=ps)  # p for branch 1, 1 - p for branch 0
            for j, m in enumerate(left):
                ps[j, m:] = one
            total += np.log(np.multiply.reduce(ps.astype(np.float64), axis=0))
        out = np.empty(n)
        out[order] = sums
        return out

    def inputs(self, words: pa.Array, group: np.ndarray, part: str, before=None, of=None):
        """Of the head or the tail of (word, language) pairs: sizes in bits, and of every bit the four log odds and
        the mark. Heads are behind words whose endings raise predictor 1's hashes by ``before``, of pair number ``of``."""
        size, branch, keys = self.code.events(words, group, part=part)
        odds = np.empty((len(branch), 4), np.int16)
        for k in (0, 1, 2, 3) if before is None else (0, 2, 3):
            slot = _slot(keys[k], k)
            odds[:, k] = self.odds[k].take(slot)
        marks = self.seen.take(slot) << 1 | branch
        odds = odds.reshape(-1).view(np.int64)
        if before is None:
            return size, odds, marks
        n = size[of]
        event = _spread((np.cumsum(size) - size)[of], n)
        odds = odds.take(event)
        odds.view(np.int16)[1::4] = self.odds[1].take(_slot(keys[1].take(event) + np.repeat(before, n), 1))
        return n, odds, marks.take(event)

    def score(self, array: pa.Array):
        """(n_tokens, base of listed words, known listed tokens, score, bits, other words of each text)."""
        words, inverse, owner = _distinct(array)
        n = len(array)
        every = pa.concat_arrays([words.cast(pa.large_binary()), pa.array([b"\n"], pa.large_binary())])
        listed, place = self.find(every)
        count = np.zeros(len(every))
        count[listed] = self.counts[place]
        is_hot = place < len(self.hot_counts)
        hot, by_group = np.flatnonzero(listed)[is_hot], self.hot_counts[place[is_hot]]
        tokens, ends, token, endings, before = _tokens(words, inverse, owner, n)
        text_of = np.repeat(np.arange(n), tokens + 1)
        # the likeliest language before every token
        share = (self.group_tokens + 1) / (self.tokens + GROUPS)
        signal = np.zeros((GROUPS, len(every)))
        signal[:, hot] = np.log((by_group + share) / (count[hot, None] + 1) / share).T
        best, group = np.full(len(token), -np.inf), np.zeros(len(token), np.int64)
        for g in range(GROUPS):
            one = signal[g].take(token)
            run = np.cumsum(one) - one
            run += np.repeat(math.log(share[g]) - run[ends - tokens], tokens + 1)
            better = run > best
            best[better] = run[better]
            group[better] = g
        # coded bits of the distinct (word's tail, language) pairs and (word's head, language, ending before), and
        # the texts' bits one after another
        def distinct(key, kinds):
            used = np.flatnonzero(np.bincount(key, minlength=kinds))
            number = np.zeros(kinds, np.int64)
            number[used] = np.arange(len(used))
            return used, number[key]
        pair, token_tail = distinct(token * GROUPS + group, len(every) * GROUPS)
        parts = [self.inputs(every.take(pa.array(p // GROUPS)), p % GROUPS, "tail")
                 for p in (pair[k:k + PAIRS_AT_ONCE] for k in range(0, len(pair), PAIRS_AT_ONCE))]
        tail_size = np.concatenate([p[0] for p in parts])
        sample, head = _heads(every)
        pair, token_head = distinct(head[token] * GROUPS + group, len(sample) * GROUPS)
        coded = pa.array(token_head * len(endings) + before).dictionary_encode()
        key = coded.dictionary.to_numpy()
        order = np.argsort(key)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        token_head = place[coded.indices.to_numpy()]
        after, of = _after(endings)[key[order] % len(endings)], key[order] // len(endings)
        n_tails = len(parts)
        for k in range(0, len(pair), HEADS_AT_ONCE):
            p, at = pair[k:k + HEADS_AT_ONCE], slice(*np.searchsorted(of, [k, k + HEADS_AT_ONCE]))
            parts.append(self.inputs(every.take(pa.array(sample[p // GROUPS])), p % GROUPS, "head", after[at], of[at] - k))
        head_size = np.concatenate([p[0] for p in parts[n_tails:]])
        inputs, marks = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
        del parts, coded, key, order, place
        # a token's bits: its head's, then its tail's
        run = np.stack([head_size[token_head], tail_size[token_tail]], 1).reshape(-1)
        tail_first = np.cumsum(tail_size) - tail_size
        head_first = int(tail_size.sum()) + np.cumsum(head_size) - head_size
        first = np.stack([head_first[token_head], tail_first[token_tail]], 1).reshape(-1)
        size = run[0::2] + run[1::2]
        stream = np.repeat((first - (np.cumsum(run) - run)).astype(np.int32), run)
        for k in range(0, len(stream), 1 << 20):
            part = stream[k:k + (1 << 20)]
            part += np.arange(k, k + len(part), dtype=np.int32)
        del run, first
        stop = np.cumsum(size)[ends]
        bits = np.diff(np.append(0, stop))
        pieces = -(-bits // LANE_BITS)
        text = np.repeat(np.arange(n), pieces)
        k = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = (stop - bits)[text] + k * bits[text] // pieces[text]
        until = (stop - bits)[text] + (k + 1) * bits[text] // pieces[text]
        log_p = self.lanes(inputs, marks, stream, begin, until - begin)
        score = np.bincount(text, weights=log_p, minlength=n) / math.log(10)
        base = np.where(listed, np.log10((count + 1) / (self.tokens + self.kinds + 1)), 0.0)
        base_sum = np.bincount(text_of, weights=base[token], minlength=n)
        known = np.bincount(text_of, weights=(count > 0)[token], minlength=n).astype(np.int64)
        # the others: distinct (text, word) with their number
        rare = ~listed[token]
        pair, number = np.unique(text_of[rare] * len(every) + token[rare], return_counts=True)
        of, word = pair // len(every), pair % len(every)
        lists = pa.ListArray.from_arrays(
            np.searchsorted(of, np.arange(n + 1)).astype(np.int32),
            pa.StructArray.from_arrays([every.take(pa.array(word)).cast(pa.binary()), pa.array(number, pa.int64())], ["word", "n"]))
        return tokens + 1, base_sum, known, score, bits, lists


@H.lean
def _score(batches, held):
    model = held.value
    for part in (p for b in batches for p in H.parts(b, limit=SCORE_BYTES)):
        tokens, base, known, score, bits, rare = model.score(part.column("text"))
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("held"), pa.array(tokens, pa.int64()), pa.array(known), pa.array(base),
             pa.array(score), pa.array(bits, pa.int64()), rare],
            ["doc_id", "held_out", "n_tokens", "known", "base", "score", "coded_bits", "rare"])


def fit(docs: DataFrame):
    """(model, vocabulary) of (text, held, grp); the model learns from rows that are not held out,
    the vocabulary (word, train) lists the words of all rows."""
    spark = docs.sparkSession
    group = [f"t{g}" for g in range(GROUPS)]
    counted = docs.select("text", "held", "grp").mapInArrow(
        _count_words, "word binary, " + ", ".join(f"{t} bigint" for t in group) + ", every bigint")
    ends = docs.groupBy("grp").agg(F.count_if(~F.col("held")).alias("n"), F.count("*").alias("every")).select(
        F.lit(b"\n").alias("word"), *[F.when(F.col("grp") == g, F.col("n")).otherwise(0).alias(t) for g, t in enumerate(group)], "every")
    vocabulary = counted.unionByName(ends).groupBy("word").agg(*[F.sum(c).alias(c) for c in (*group, "every")])
    vocabulary = written(vocabulary.withColumn("train", sum((F.col(t) for t in group[1:]), F.col(group[0]))), "vocabulary")
    totals = [F.sum(t) for t in group] + [F.count_if(F.col("train") > 0), F.sum("every"), F.count("*")]
    power = F.length(F.bin("every")) - 1
    by_power = vocabulary.groupBy(power.alias("power")).agg(*totals).orderBy(F.desc("power")).collect()  # a row for each power of two
    *tokens, kinds, every, _ = [sum(v) for v in zip(*(r[1:] for r in by_power))] or [0] * (GROUPS + 3)
    listed = np.cumsum([r[-1] for r in by_power]) <= LISTED
    least = 1 << by_power[int(listed.sum()) - 1].power if listed.any() else every + 1
    is_hot = F.col("every") * HOT_SHARE >= every
    frequent = vocabulary.where(is_hot | (F.col("every") >= least)).select("word", "train", *[
        F.when(is_hot, F.col(t)).alias(t) for t in group]).toArrow()  # at most LISTED rows, or HOT_SHARE
    seen = vocabulary.where("train > 0").select("word", "train")
    pairs = seen.mapInArrow(_count_symbols, "key int, n bigint").groupBy("key").agg(F.sum("n").alias("n")).toArrow()  # at most 2 ** 24
    code = Code(pairs.column("key").to_numpy().astype(np.int64), pairs.column("n").to_numpy())
    code_held = spark.sparkContext.broadcast(code)
    schema = "table int, block int, slots binary, counts binary"
    bits = vocabulary.where("train > 0").select("word", *group).mapInArrow(lambda b: _count_bits(b, code_held), schema)
    heads = docs.where("NOT held").select("text").mapInArrow(lambda b: _count_heads(b, code_held), schema)
    blocks = bits.unionByName(heads).groupBy("table", "block").applyInArrow(_sum_blocks, "table int, block int, odds binary, seen binary")
    odds = [np.zeros(1 << b, np.int16) for b in SLOT_BITS]
    gate = np.zeros(1 << SLOT_BITS[3], np.uint8)
    for r in blocks.toLocalIterator():  # tables of fixed size
        at = slice(r.block << BLOCK_BITS, (r.block + 1) << BLOCK_BITS)
        odds[r.table][at] = np.frombuffer(r.odds, "<i2")
        if r.table == 3:
            gate[at] = np.frombuffer(r.seen, np.uint8)
    known = pc.is_valid(frequent.column("t0"))
    hot, others = frequent.filter(known), frequent.filter(pc.invert(known))
    words = lambda t: t.column("word").cast(pa.large_binary()).combine_chunks()
    by_group = np.stack([hot.column(t).to_numpy() for t in group], 1)
    model = Model(code, odds, gate, words(hot), by_group, np.array(tokens), kinds, words(others), others.column("train").to_numpy())
    return model, vocabulary


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, coded_bits (binary decisions)."""
    spark = docs.sparkSession
    ship_package(spark)
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held"), lang.alias("lang"))
    top = d.where("lang IS NOT NULL AND NOT held").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    number = F.lit(LANGUAGES)
    for g, r in enumerate(top):
        number = F.when(F.col("lang") == r.lang, g).otherwise(number)
    d = d.withColumn("grp", F.coalesce(number, F.lit(LANGUAGES)))
    model, vocabulary = fit(d)
    held = spark.sparkContext.broadcast(model)
    scored = written(d.select("doc_id", "text", "held").mapInArrow(
        lambda b: _score(b, held), "doc_id bigint, held_out boolean, n_tokens bigint, known bigint, base double, score double, "
        "coded_bits bigint, rare array<struct<word:binary,n:bigint>>").withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("row", F.inline("rare")).join(vocabulary.select("word", "train"), "word")
    one = F.log10((F.col("train") + 1) / F.lit(float(model.tokens + model.kinds + 1)))
    rare = rare.groupBy("row").agg(F.sum(F.col("n") * one).alias("b"), F.sum(F.when(F.col("train") > 0, F.col("n")).otherwise(0)).alias("k"))
    out = scored.drop("rare").join(rare, "row", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("b", F.lit(0.0))).alias("base_score"),
        "score", "coded_bits")


def query(spark, sf_dir):
    from ratinglab.llm.common import table
    return score(table(spark, sf_dir, "documents"))
