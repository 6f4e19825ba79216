"""Target-distribution importance resampling.

Features are all runs of one or two consecutive words, hashed into ``BUCKETS`` by crc32 of their
UTF-8 bytes. A bucket's gain is the log ratio of its share among the target texts and among all
documents; gains are one array of ``BUCKETS`` whole numbers, a document's weight the floored mean of
its features' gains, and its score the weight plus keyed Gumbel noise, so that the highest scores are
a draw without replacement in proportion to the weights.

The cutoff is found by weighted median-of-medians selection over the written keys (score falling,
doc_id, row): every partition names the median of its remaining keys, the medians weighted by the
sizes give a pivot, and counting the keys before it discards at least a quarter of those remaining,
until few are left, which are sorted. One job a round: each task answers with its counts on both sides
of the pivot and its medians of both. Remaining keys are written anew whenever they have shrunk to a
quarter, so all rounds together read little more than the first. Only winners are sorted (by ranges);
ranks are places within a range plus the sizes of the ranges before. The driver holds a few numbers
for each partition and the array of gains.

Defined cases: null or empty texts have no words, no features and weight 0; texts with under
``LEAST`` words are never drawn (rank null); ties go to the smaller doc_id (null last), then to the
earlier row; repeated rows are rows of their own; an empty table gives an empty result; an empty
target counts as no features; a text of any length is read whole; other columns are ignored. A null
doc_id's noise is that of ``7:``.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ratinglab.llm import hashing as H
from ratinglab.llm.common import table, written
from ratinglab.session import ship_package

BUCKETS = 10000
#: Words a document needs to be drawn, drawn hundredths of those, key of the noise.
LEAST, SHARE, SEED = 20, 25, 7
#: Remaining keys that are sorted at the driver instead of halved again.
FEW = 10000
#: Longest word whose checksum is computed together with others'.
SHORT = 64

_SCORED = "doc_id bigint, n_features bigint, n_words bigint, weight bigint, score bigint"
_CRC = 0xEDB88320


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(_CRC), t >> 1)
    return t


TABLE = _crc_table()


class Shift:
    """crc32 of a text followed by n bytes, as far as it depends on the text: four tables for each n."""

    def __init__(self):
        self.rows: dict[int, int] = {}
        self.tables = np.empty((0, 4, 256), np.uint32)
        # the effect of one zero byte on each bit of the register
        one = np.uint32(1) << np.arange(32, dtype=np.uint32)
        self.powers = [TABLE[one & 255] ^ (one >> np.uint32(8))]

    @staticmethod
    def apply(op: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.zeros_like(x)
        for bit in range(32):
            out ^= np.where(x >> np.uint32(bit) & np.uint32(1), op[bit], np.uint32(0))
        return out

    def table(self, n: int) -> np.ndarray:
        x = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
        k = 0
        while n >> k:
            if k == len(self.powers):
                self.powers.append(self.apply(self.powers[-1], self.powers[-1]))
            if n >> k & 1:
                x = self.apply(self.powers[k], x)
            k += 1
        return x

    def __call__(self, crc: np.ndarray, n: np.ndarray) -> np.ndarray:
        lengths, inverse = np.unique(n, return_inverse=True)
        if len(self.rows) + len(lengths) > 4096:  # a bounded cache, whatever the lengths
            self.rows, self.tables = {}, np.empty((0, 4, 256), np.uint32)
        new = [x for x in lengths.tolist() if x not in self.rows]
        if new:
            self.rows |= {x: len(self.tables) + i for i, x in enumerate(new)}
            self.tables = np.concatenate([self.tables, np.stack([self.table(x) for x in new])])
        t = self.tables[np.array([self.rows[x] for x in lengths.tolist()])]
        byte = np.uint32(255)
        return (t[inverse, 0, crc & byte] ^ t[inverse, 1, crc >> np.uint32(8) & byte]
                ^ t[inverse, 2, crc >> np.uint32(16) & byte] ^ t[inverse, 3, crc >> np.uint32(24)])


def checksums(data: np.ndarray, s: np.ndarray, e: np.ndarray, start: int = 0) -> np.ndarray:
    """crc32 of each byte range, continuing a checksum ``start``."""
    size = e - s
    out = np.full(len(s), np.uint32(start) ^ np.uint32(0xFFFFFFFF), np.uint32)
    order = np.argsort(size, kind="stable")
    order = order[:np.searchsorted(size[order], SHORT, side="right")]
    first = np.searchsorted(size[order], np.arange(SHORT + 1), side="right")
    for j in range(SHORT):
        on = order[first[j]:]  # words longer than j bytes
        if not len(on):
            break
        out[on] = TABLE[(out[on] ^ data[s[on] + j]) & np.uint32(255)] ^ (out[on] >> np.uint32(8))
    out ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > SHORT):
        out[i] = zlib.crc32(data[s[i]:e[i]].tobytes(), start)
    return out


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def features(data: np.ndarray, off: np.ndarray, shift: Shift):
    """Bucket and text number of every feature, and the number of words of each text."""
    s, e, owner = H.word_spans(data, off, H.LETTERS)
    n_words = np.bincount(owner, minlength=len(off) - 1)
    if not len(s):
        return np.empty(0, np.int64), np.empty(0, np.int64), n_words
    low = _LOWER[data]
    crc = checksums(low, s, e)
    both = np.flatnonzero(owner[1:] == owner[:-1])
    # crc of "a b": a's checksum moved on by the bytes of " b", with the checksum of " b" itself
    after = checksums(low, s[both + 1], e[both + 1], zlib.crc32(b" "))
    pair = shift(crc[both], e[both + 1] - s[both + 1] + 1) ^ after
    bucket = np.concatenate([crc, pair]).astype(np.int64) % BUCKETS
    return bucket, np.concatenate([owner, owner[both]]), n_words


def _texts(batches):
    """(batch slice, bytes, offsets) of bounded runs of texts."""
    for batch in batches:
        for part in H.parts(batch):
            yield part, *H.texts(part.column("text"))


def _counts(batches):
    total, shift = np.zeros(BUCKETS, np.int64), Shift()
    for _, data, off in _texts(batches):
        bucket, _, _ = features(data, off, shift)
        total += np.bincount(bucket, minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Features of all texts in each bucket; tasks send at most ``BUCKETS`` sums each."""
    rows = texts.select("text").mapInArrow(_counts, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for r in rows.collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(target share / source share)) of each bucket, counts raised by one."""
    s_all, t_all = float(source.sum()), float(target.sum())
    return np.array([math.floor(1000.0 * math.log((t + 1.0) * (s_all + BUCKETS) / ((s + 1.0) * (t_all + BUCKETS))))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(doc_id: int | None) -> int:
    h = int(hashlib.sha256(f"{SEED}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000.0 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scores(batches, gain: np.ndarray):
    shift = Shift()
    for part, data, off in _texts(batches):
        bucket, owner, n_words = features(data, off, shift)
        n = np.bincount(owner, minlength=len(n_words))
        total = np.zeros(len(n), np.int64)
        np.add.at(total, owner, gain[bucket])
        weight = np.where(n > 0, total // np.maximum(n, 1), 0)
        ids = part.column("doc_id")
        extra = np.array([noise(i) for i in ids.to_pylist()], np.int64)
        yield pa.RecordBatch.from_pydict({"doc_id": ids, "n_features": pa.array(n, pa.int64()), "n_words": pa.array(n_words, pa.int64()),
                                          "weight": pa.array(weight, pa.int64()), "score": pa.array(weight + extra, pa.int64())})


def scored(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_features, n_words, weight, score of every document."""
    ship_package(docs.sparkSession)
    gain = gains(bucket_counts(docs), bucket_counts(target))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda b: _scores(b, gain), _SCORED)


# ------------------------------------------------------------------ selection

#: A key is (-score, doc_id is null, doc_id, row): the smallest keys are drawn first.
_KEY = ("a", "b", "c", "d")
_KEYS = "a bigint, b bigint, c bigint, d bigint"


def key_columns() -> list[Column]:
    return [(-F.col("score")).alias("a"), F.col("doc_id").isNull().cast("long").alias("b"),
            F.coalesce("doc_id", F.lit(0).cast("long")).alias("c"), F.col("row").alias("d")]


def before(key: tuple, equal: bool = False) -> Column:
    """Keys before ``key`` (or equal to it)."""
    out = F.lit(equal)
    for name, value in zip(reversed(_KEY), reversed(key)):
        out = (F.col(name) < F.lit(value)) | ((F.col(name) == F.lit(value)) & out)
    return out


def _sides(batches, pivot: tuple | None):
    """Of a task's keys: how many come before the pivot and how many after it, with both medians
    (no pivot: all of them count as after it)."""
    parts = [np.stack([b.column(c).to_numpy() for c in _KEY], axis=1) for b in batches if b.num_rows]
    keys = np.concatenate(parts) if parts else np.empty((0, 4), np.int64)
    keys = keys[np.lexsort(keys.T[::-1])]
    cut = same = 0
    if pivot is not None and len(keys):
        lo = np.zeros(len(keys), bool)
        eq = np.ones(len(keys), bool)
        for j, p in enumerate(pivot):
            lo |= eq & (keys[:, j] < p)
            eq &= keys[:, j] == p
        cut, same = int(lo.sum()), int(eq.sum())
    for side, part in ((0, keys[:cut]), (1, keys[cut + same:])):
        if len(part):
            middle = part[(len(part) - 1) // 2].tolist()
            yield pa.RecordBatch.from_pydict({"side": pa.array([side], pa.int32()), "n": pa.array([len(part)], pa.int64()),
                                              **{c: pa.array([x], pa.int64()) for c, x in zip(_KEY, middle)}})


def weighted_median(medians: list[tuple[tuple, int]]) -> tuple:
    half, seen = sum(n for _, n in medians), 0
    for key, n in sorted(medians):
        seen += n
        if 2 * seen >= half:
            return key
    raise ValueError("no medians")


def cutoff(keys: DataFrame, k: int, few: int = FEW) -> tuple | None:
    """The k-th smallest key (k from 1; None for k = 0)."""
    if k <= 0:
        return None
    keys = keys.select(*_KEY)

    def ask(df, pivot):
        rows = df.mapInArrow(lambda b: _sides(b, pivot), "side int, n bigint, " + _KEYS).collect()  # two for each task
        return [[((r.a, r.b, r.c, r.d), r.n) for r in rows if r.side == side] for side in (0, 1)]
    medians = ask(keys, None)[1]
    left = stored = sum(n for _, n in medians)
    if k > left:
        raise ValueError("fewer keys than asked for")
    low = high = None  # exclusive bounds of the remaining keys
    while left > few:
        pivot = weighted_median(medians)
        rest = keys
        if low is not None:
            rest = rest.where(~before(low, True))
        if high is not None:
            rest = rest.where(before(high))
        if 4 * left <= stored:
            keys = rest = written(rest, "resample-keys")
            stored = left
        sides = ask(rest, pivot)
        n = sum(x for _, x in sides[0])
        if k <= n:
            high, left, medians = pivot, n, sides[0]
        else:
            after = sum(x for _, x in sides[1])
            if k <= left - after:  # rows are part of the key: the pivot is one row
                return pivot
            k, low, left, medians = k - (left - after), pivot, after, sides[1]
    rest = keys
    if low is not None:
        rest = rest.where(~before(low, True))
    if high is not None:
        rest = rest.where(before(high))
    return sorted(tuple(r) for r in rest.collect())[k - 1]


def drawn(df: DataFrame, eligible: Column, share: int = SHARE, few: int = FEW) -> DataFrame:
    """df (doc_id, score and more) with ``rank``: floor(share * N / 100) of the N eligible rows by
    highest score, ties to the smaller doc_id."""
    spark = df.sparkSession
    rows = written(df.select("*", eligible.alias("eligible"), F.monotonically_increasing_id().alias("row")), "resample-scores")
    names = [c for c in rows.columns if c not in ("eligible", "row")]
    able = rows.where("eligible").select(*key_columns())
    last = cutoff(able, share * able.count() // 100, few)
    if last is None:
        return rows.select(*names, F.lit(None).cast("long").alias("rank"))
    tagged = rows.select(*names, "eligible", *key_columns())
    won = F.col("eligible") & before(last, True)
    winners = tagged.where(won).orderBy(*_KEY).select(*names, F.monotonically_increasing_id().alias("place"))
    winners = written(winners, "resample-winners")
    low = (1 << 33) - 1
    sizes = winners.groupBy(F.shiftrightunsigned("place", 33).alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
    offsets, total = {}, 0
    for r in sorted(sizes, key=lambda r: r.part):
        offsets[r.part], total = total, total + r.n
    starts = spark.createDataFrame(list(offsets.items()), "part bigint, start bigint")
    place = F.col("place")
    ranked = (winners.withColumn("part", F.shiftrightunsigned("place", 33)).join(F.broadcast(starts), "part")
              .select(*names, (F.col("start") + place.bitwiseAND(low) + 1).alias("rank")))
    others = tagged.where(~won).select(*names, F.lit(None).cast("long").alias("rank"))
    return ranked.unionByName(others)


def query(spark, sf_dir):
    documents, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    out = drawn(scored(documents, benchmark), F.col("n_words") >= LEAST)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def _nibbles() -> list[int]:
    t = list(range(16))
    for _ in range(4):
        t = [x >> 1 ^ _CRC if x & 1 else x >> 1 for x in t]
    return t


#: crc32 over the hex digits of a text, low digit of each byte first; words and pairs as lists.
ORACLE = f"""
WITH texts AS (
  SELECT row_number() OVER () AS r, 0 AS kind, doc_id, text FROM documents
  UNION ALL SELECT row_number() OVER () AS r, 1 AS kind, NULL AS doc_id, text FROM benchmark),
worded AS (
  SELECT r, kind, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts),
feats AS (
  SELECT r, kind, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM worded),
hashed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(range(1, 2 * octet_length(encode(f)), 2), lambda i:
    [strpos('0123456789ABCDEF', substr(hex(encode(f)), i + 1, 1))::UBIGINT - 1, strpos('0123456789ABCDEF', substr(hex(encode(f)), i, 1))::UBIGINT - 1]))),
    lambda c, x: xor({_nibbles()}[CAST((xor(c, x) & 15) + 1 AS BIGINT)]::UBIGINT, c >> 4)), 4294967295::UBIGINT) % {BUCKETS} AS b
  FROM (SELECT DISTINCT f FROM feats)),
counted AS (
  SELECT r, kind, b, count(*) AS n FROM feats JOIN hashed USING (f) GROUP BY r, kind, b),
buckets AS (
  SELECT b, coalesce(sum(n) FILTER (kind = 0), 0) AS s, coalesce(sum(n) FILTER (kind = 1), 0) AS t FROM counted GROUP BY b),
gain AS (
  SELECT b, CAST(floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + {BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + {BUCKETS})::DOUBLE))) AS BIGINT) AS g
  FROM buckets),
weights AS (
  SELECT r, sum(n) AS n_features, CAST(floor(sum(n * g) / sum(n)) AS BIGINT) AS weight FROM counted JOIN gain USING (b) WHERE kind = 0 GROUP BY r),
scores AS (
  SELECT d.r, d.doc_id, len(d.w) AS n_words, coalesce(CAST(w.n_features AS BIGINT), 0) AS n_features, coalesce(w.weight, 0) AS weight,
    coalesce(w.weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5)
      / 4294967296))) AS BIGINT) AS score
  FROM worded d LEFT JOIN weights w ON w.r = d.r WHERE d.kind = 0),
ranked AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, r) AS rank, count(*) OVER () AS n FROM scores WHERE n_words >= {LEAST})
SELECT s.doc_id, s.n_features, s.weight, s.score, CASE WHEN k.rank <= {SHARE} * k.n // 100 THEN k.rank END AS rank
FROM scores s LEFT JOIN ranked k ON k.r = s.r
"""
