"""N-gram Jaccard join: documents whose 5-word shingle sets have a similarity of at least 0.8.

A document's set is put in one global order of shingles: by how loaded the shingle's slot is in a
corpus-wide count table of fixed size, rarer first, then by hash. Sets of similarity 0.8 share one
of their first n - ceil(0.8 n) + 1 shingles whatever the order is; this one keeps passages that
many documents share out of those prefixes.

1. Documents of equal sets are one node. Nodes that share a prefix shingle share a tile; only pairs
   whose sizes are within a ratio of 0.8 (the size band) are candidates.
2. Each node of a tile is paired with the tile's smallest node; linked nodes are joined in
   components. Pairs inside a component need no test. Tiles over ``WIDE`` nodes that still span
   several components repeat this ``ROUNDS`` times with up to ``HUBS`` nodes (the first by hash)
   outside the components of the hubs before.
3. Nodes of wide tiles that still span several components get new prefixes, ordered by the exact
   number of those nodes that hold a shingle: documents with a shared passage and words of their
   own leave the tiles. All pairs of a tile across components are then candidates, tiles of any
   size; a pair is only formed where enough of both sets is left from the shared shingle on
   (positional bound).
4. Candidates are tested by their hashed bitmaps: bits set in one signature alone are shingles that
   the other lacks, so their count bounds the overlap from above. Survivors' sorted hash arrays
   are intersected.

Shingles are 64-bit hashes. Defined cases: null, empty or blank texts have an empty set, are linked
with nothing and are their own component (their doc_id); fewer than 5 words are one shingle; a
component's id is the smallest non-null doc_id in it, null if there is none; repeated rows are
repeated documents; an empty table gives an empty result; other columns are ignored by
``components`` and carried along by ``representatives``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ratinglab.llm import hashing as H
from ratinglab.llm.common import written
from ratinglab.session import ship_package

K, SIMILARITY = 5, 80  # words in a shingle, percent
SLOT_BITS, BLOCKS = 22, 256
BITMAP_BITS = 2048
WIDE, ROUNDS, HUBS = 16, 2, 16
BLOCK = 512  # nodes of a wide tile that are compared at once
_U = np.uint64
_SEEDS = (_U(0x243F6A8885A308D3), _U(0x13198A2E03707344))


def _shingles(data: np.ndarray, off: np.ndarray):
    """(hash, text number) of every shingle, repeats included."""
    s, e, owner = H.word_spans(data, off)
    words = H.word_hashes(data, s, e)
    h = H.shingle_hashes(words, K)
    inside = np.flatnonzero(owner[:len(h)] == owner[K - 1:][:len(h)]) if len(h) else np.empty(0, np.int64)
    count = np.bincount(owner, minlength=len(off) - 1)
    hashes, texts = [h[inside]], [owner[inside]]
    for n in range(1, K):  # whole sequences of n words
        t = np.flatnonzero(count == n)
        if len(t):
            at = np.searchsorted(owner, t)
            hashes.append(H.mix(H.shingle_hashes(words, n)[at] + _U(n)))
            texts.append(t)
    return np.concatenate(hashes), np.concatenate(texts)


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> _U(64 - SLOT_BITS)).astype(np.int64)


@H.lean
def _count_slots(batches):
    table = np.zeros(1 << SLOT_BITS, np.int32)
    for b in batches:
        data, off = H.texts(b.column(0))
        for x, y in H.slices(off):
            h, _ = _shingles(data[off[x]:off[y]], off[x:y + 1] - off[x])
            np.add.at(table, _slot(h), np.int32(1))
    if table.any():
        yield pa.RecordBatch.from_pydict({"block": pa.array(range(BLOCKS), pa.int32()), "counts": [
            np.minimum(t, 65535).astype("<u2").tobytes() for t in np.split(table, BLOCKS)]})


def _sum_blocks(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(c.as_py(), "<u2").astype(np.int64) for c in table.column("counts"))
    return pa.table({"block": table.column("block")[:1], "counts": [total.tobytes()]},
                    pa.schema([("block", pa.int32()), ("counts", pa.binary())]))


def _slot_classes(docs: DataFrame) -> np.ndarray:
    """Load class of every slot, a table of 2 ** SLOT_BITS bytes whatever the corpus: steps of a
    64th of the mean up to twice the mean, of an eighth of an octave above. A task's count of a
    slot is cut at 65535, which only moves places in the order."""
    rows = (docs.select("text").mapInArrow(_count_slots, "block int, counts binary")
            .groupBy("block").applyInArrow(_sum_blocks, "block int, counts binary").collect())
    load = np.zeros((BLOCKS, (1 << SLOT_BITS) // BLOCKS))
    for r in rows:
        load[r.block] = np.frombuffer(r.counts, np.int64)
    load = load.ravel() / max(load.mean(), 1e-9)
    return np.where(load < 2, np.floor(load * 64), np.minimum(128 + np.floor(8 * np.log2(np.maximum(load, 2) / 2)), 255)).astype(np.uint8)


def _ordered(data, off, classes):
    """Distinct shingles of every text in the global order (without classes: by hash): (hash, text
    number, first, size)."""
    h, owner = _shingles(data, off)
    n = len(off) - 1
    i = np.argsort(h)
    if classes is not None:
        i = i[np.argsort(classes[_slot(h[i])], kind="stable")]
    i = i[np.argsort(owner[i].astype(np.uint16 if n < 65536 else np.int64), kind="stable")]
    h, owner = h[i], owner[i]
    keep = np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))[:len(h)]
    h, owner = h[keep], owner[keep]
    size = np.bincount(owner, minlength=n)
    return h, owner, np.cumsum(size) - size, size


def _digests(h, owner, n):
    out = []
    for seed in _SEEDS:
        total = np.zeros(n, _U)
        if len(h):
            start = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            total[owner[start]] = np.add.reduceat(H.mix(h ^ seed), start)
        out.append(total.view(np.int64))
    return out


def _bitmaps(h, owner, n) -> np.ndarray:
    bits = np.zeros((n, BITMAP_BITS), np.uint8)
    bits[owner, (h & _U(BITMAP_BITS - 1)).astype(np.int64)] = 1
    return np.packbits(bits, axis=1)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(rows.shape[1]), len(rows), [None, pa.py_buffer(
        np.ascontiguousarray(rows))]).cast(pa.binary())


@H.lean
def _sets(batches, held):
    classes = held.value
    for b in batches:
        data, off = H.texts(b.column(1))
        for x, y in H.slices(off, most=4096):
            h, owner, first, size = _ordered(data[off[x]:off[y]], off[x:y + 1] - off[x], classes)
            prefix = np.where(size > 0, size - (SIMILARITY * size + 99) // 100 + 1, 0)
            ends = np.cumsum(prefix)
            at = np.arange(int(prefix.sum())) + np.repeat(first - (ends - prefix), prefix)
            d1, d2 = _digests(h, owner, y - x)
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column(0).slice(x, y - x), "n": pa.array(size, pa.int64()), "d1": d1, "d2": d2,
                "prefix": pa.ListArray.from_arrays(np.append(0, ends).astype(np.int32), h[at].view(np.int64)),
                "bitmap": _binary(_bitmaps(h, owner, y - x))})


@H.lean
def _full_sets(batches):
    """(id, d1, d2, text) -> the sorted hashes of texts whose digests are those of the node."""
    for b in batches:
        data, off = H.texts(b.column(3))
        for x, y in H.slices(off, most=4096):
            h, owner, first, size = _ordered(data[off[x]:off[y]], off[x:y + 1] - off[x], None)
            d1, d2 = _digests(h, owner, y - x)
            same = (d1 == b.column(1).to_numpy()[x:y]) & (d2 == b.column(2).to_numpy()[x:y])
            t = np.flatnonzero(same)
            yield pa.RecordBatch.from_pydict({
                "id": b.column(0).slice(x, y - x).take(pa.array(t)),
                "hashes": pa.array([h[first[k]:first[k] + size[k]].view(np.int64) for k in t], pa.list_(pa.int64()))})


@H.lean
def _bound(batches):
    """Pairs whose bitmaps allow the overlap they need. x, y, nx, ny, bx, by -> x, y."""
    for b in batches:
        nx, ny = b.column(2).to_numpy(), b.column(3).to_numpy()
        bits = [np.frombuffer(b"".join(c.to_pylist()), _U).reshape(b.num_rows, -1) for c in (b.column(4), b.column(5))]
        only_x = np.bitwise_count(bits[0] & ~bits[1]).sum(axis=1, dtype=np.int64)
        only_y = np.bitwise_count(bits[1] & ~bits[0]).sum(axis=1, dtype=np.int64)
        most = np.minimum(nx - only_x, ny - only_y)
        yield b.select([0, 1]).filter(pa.array(100 * most >= SIMILARITY * (nx + ny - most)))


def _compare(cell: pa.Table) -> pa.Table:
    """Pairs x < y of two blocks (or within one) that all bounds allow, from the first tile that
    they share; one tile's rows. before: the tiles of a node that come first in its order."""
    id_, n, r, comp, block = (cell.column(c).to_numpy() for c in ("id", "n", "r", "comp", "block"))
    bits = np.frombuffer(b"".join(cell.column("bitmap").to_pylist()), _U).reshape(len(id_), -1)
    low, high = cell.column("lo")[0].as_py(), cell.column("hi")[0].as_py()
    a, b = np.flatnonzero(block == low), np.flatnonzero(block == high)
    before, sets, out = cell.column("before"), {}, []

    def earlier(k: int) -> set:
        if k not in sets:
            sets[k] = set(before[int(k)].as_py())
        return sets[k]
    for k in range(0, len(a), 32):
        i = a[k:k + 32, None]
        total, left = n[i] + n[b], np.minimum(n[i] - r[i], n[b] - r[b])
        ok = (comp[i] != comp[b]) & ((100 + SIMILARITY) * left >= SIMILARITY * total)
        ok &= (id_[i] < id_[b]) if low == high else True
        p, q = np.nonzero(ok)
        p, q = i[p, 0], b[q]
        only_p = np.bitwise_count(bits[p] & ~bits[q]).sum(axis=1, dtype=np.int64)
        only_q = np.bitwise_count(bits[q] & ~bits[p]).sum(axis=1, dtype=np.int64)
        most = np.minimum(n[p] - only_p, n[q] - only_q)
        hit = np.flatnonzero(100 * most >= SIMILARITY * (n[p] + n[q] - most))
        hit = [k for k in hit if earlier(p[k]).isdisjoint(earlier(q[k]))]
        out.append(np.stack([np.minimum(id_[p], id_[q]), np.maximum(id_[p], id_[q])])[:, hit])
    x, y = np.concatenate(out, axis=1) if out else np.empty((2, 0), np.int64)
    return pa.table({"x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int64())})


@H.lean
def _exact(batches):
    for b in batches:
        keep = []
        for p, q in zip(b.column(2), b.column(3)):
            p, q = p.values.to_numpy(), q.values.to_numpy()
            both = len(np.intersect1d(p, q, assume_unique=True))
            keep.append(100 * both >= SIMILARITY * (len(p) + len(q) - both))
        yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))


class _Join:
    """The join's tables and steps."""

    def __init__(self, docs: DataFrame):
        self.spark: SparkSession = docs.sparkSession
        ship_package(self.spark)
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        held = self.spark.sparkContext.broadcast(_slot_classes(self.docs))
        computed = self.docs.mapInArrow(
            lambda b: _sets(b, held), "doc_id bigint, n bigint, d1 bigint, d2 bigint, prefix array<bigint>, bitmap binary")
        # prefixes are written once for each node, so the documents pass twice
        self.sets = written(computed.select("doc_id", "n", "d1", "d2"), "sets")
        node = computed.where("n > 0").groupBy("d1", "d2", "n").agg(
            F.min("doc_id").alias("rep"), F.first("prefix").alias("prefix"), F.first("bitmap").alias("bitmap"))
        self.nodes = written(node.withColumn("id", F.monotonically_increasing_id()), "nodes")
        posting = self.nodes.select("id", "n", F.posexplode("prefix").alias("r", "h"))
        tile = posting.groupBy("h").agg(F.min("id").alias("hub"), F.count("*").alias("c")).where("c > 1")
        self.tiles = written(posting.join(tile, "h"), "tiles")
        self.member: DataFrame | None = None  # id, comp of the nodes linked so far

    def near_size(self, a: str = "nx", b: str = "ny"):
        return 100 * F.least(a, b) >= SIMILARITY * F.greatest(a, b)

    def bounded(self, pairs: DataFrame) -> DataFrame:
        """Of the pairs x, y, nx, ny those that the bitmaps allow."""
        bits = self.nodes.select("id", "bitmap")
        may = pairs.join(self.side("x", bits, "bitmap"), "x").join(self.side("y", bits, "bitmap"), "y")
        return may.select("x", "y", "nx", "ny", "bx", "by").mapInArrow(_bound, "x bigint, y bigint")

    def side(self, name: str, t: DataFrame, value: str) -> DataFrame:
        return t.select(F.col("id").alias(name), F.col(value).alias("b" + name))

    def exact(self, may: DataFrame) -> DataFrame | None:
        """The linked ones of the pairs x, y (None if there are no pairs)."""
        may = written(may, "pairs")
        if not may.count():
            return None
        full = self.full_sets(may.select(F.col("x").alias("id")).union(may.select("y")).distinct())
        both = may.join(self.side("x", full, "hashes"), "x").join(self.side("y", full, "hashes"), "y")
        return written(both.select("x", "y", "bx", "by").mapInArrow(_exact, "x bigint, y bigint"), "links")

    def full_sets(self, ids: DataFrame) -> DataFrame:
        """id, hashes of the nodes, from their representatives' texts."""
        want = self.nodes.join(ids, "id", "left_semi").select("id", "d1", "d2", "rep")
        texts = want.join(self.docs, F.col("rep").eqNullSafe(F.col("doc_id")))
        full = texts.select("id", "d1", "d2", "text").mapInArrow(_full_sets, "id bigint, hashes array<bigint>")
        return written(full.groupBy("id").agg(F.first("hashes").alias("hashes")), "hashes")

    def add(self, may: DataFrame) -> None:
        """Test pairs x, y and join what is linked. New links are contracted to links between the
        components so far; only those are joined."""
        new = self.exact(may)
        if new is None:
            if self.member is None:
                self.member = self.spark.createDataFrame([], "id bigint, comp bigint")
            return
        if self.member is None:
            self.member = connected(new)
            return
        of = lambda name: self.member.select(F.col("id").alias(name), F.col("comp").alias("c" + name))
        between = new.join(of("x"), "x", "left").join(of("y"), "y", "left").select(
            F.coalesce("cx", "x").alias("x"), F.coalesce("cy", "y").alias("y")).where("x <> y")
        moved = connected(between)
        if not moved.count():
            return
        grown = self.member.join(moved.select(F.col("id").alias("comp"), F.col("comp").alias("to")), "comp", "left")
        fresh = moved.join(self.member.select("id"), "id", "left_anti")
        self.member = written(grown.select("id", F.coalesce("to", "comp").alias("comp")).unionByName(fresh), "member")

    def open_rows(self, tiles: DataFrame) -> DataFrame:
        """Rows of the tiles that span several components, with the component."""
        t = tiles.join(self.member, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        span = t.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
        return written(t.join(span.select("h"), "h").select(*tiles.columns, "comp"), "open")

    def next_hubs(self, rows: DataFrame, used: DataFrame) -> DataFrame:
        """Rows of up to HUBS nodes of each tile outside the components of its hubs (h, id) so far."""
        done = used.join(self.member, "id", "left").select("h", F.coalesce("comp", "id").alias("comp"))
        left = rows.join(done.distinct(), ["h", "comp"], "left_anti").withColumn("k", F.xxhash64("id"))
        first = left.groupBy("h", F.pmod("k", F.lit(HUBS))).agg(F.min(F.struct("k", "id", "n", "r", "comp")).alias("m"))
        return first.select("h", "m.id", "m.n", "m.r", "m.comp")

    def across(self, rows: DataFrame, hubs: DataFrame | None = None) -> DataFrame:
        """Pairs x, y, nx, ny of a tile (h, id, n, r, comp) in different components: all pairs of
        its rows, or those of hubs with rows. r shingles of a set come before the tile's; a pair's
        first common shingle leaves enough of both sets."""
        a = (rows if hubs is None else hubs).select(
            "h", F.col("id").alias("x"), F.col("n").alias("nx"), F.col("r").alias("rx"), F.col("comp").alias("cx"))
        b = rows.select("h", F.col("id").alias("y"), F.col("n").alias("ny"), F.col("r").alias("ry"), F.col("comp").alias("cy"))
        left = F.least(F.col("nx") - F.col("rx"), F.col("ny") - F.col("ry"))
        enough = (100 + SIMILARITY) * left >= SIMILARITY * (F.col("nx") + F.col("ny"))
        once = (F.col("x") < F.col("y")) if hubs is None else F.lit(True)
        both = (a.h == b.h) & once & (F.col("cx") != F.col("cy")) & self.near_size() & enough
        return a.join(b, both).select("x", "y", "nx", "ny")

    def exact_tiles(self, ids: DataFrame) -> DataFrame:
        """Tiles (h, id, n, r) of the nodes among themselves, rarest shingles first."""
        held = self.full_sets(ids).select("id", F.size("hashes").cast("long").alias("n"), F.explode("hashes").alias("h"))
        held = written(held, "shingles")
        shared = held.groupBy("h").agg(F.count("*").alias("k")).where("k > 1")
        # shingles of one node alone come first in its order: their number is the first rank
        mine = held.join(shared, "h").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("k", "h"))).alias("s"))
        rows = mine.select("id", "n", (F.col("n") - F.size("s")).alias("alone"), F.posexplode("s").alias("p", "e"))
        prefix = F.col("n") - F.floor((SIMILARITY * F.col("n") + 99) / 100) + 1
        return rows.withColumn("r", F.col("alone") + F.col("p")).where(F.col("r") < prefix).select(F.col("e.h").alias("h"), "id", "n", "r")

    def run(self) -> DataFrame:
        size = self.tiles.groupBy("hub").agg(F.max(F.when(F.col("id") == F.col("hub"), F.col("n"))).alias("nx"))
        first = self.tiles.where("id <> hub").select(F.col("hub").alias("x"), F.col("id").alias("y"), F.col("n").alias("ny")).distinct()
        first = first.join(size.withColumnRenamed("hub", "x"), "x").where(self.near_size())
        self.add(self.bounded(first.select("x", "y", "nx", "ny")))
        rows = self.open_rows(self.tiles)
        used = rows.where(F.col("c") > WIDE).select("h", F.col("hub").alias("id")).distinct()
        for _ in range(ROUNDS):
            wide = rows.where(F.col("c") > WIDE)
            hubs = written(self.next_hubs(wide, used), "hubs")
            if hubs.isEmpty():
                break
            self.add(self.bounded(self.across(wide, hubs).distinct()))
            used = used.union(hubs.select("h", "id"))
            rows = self.open_rows(rows.drop("comp"))
        may = self.bounded(self.across(rows.where(F.col("c") <= WIDE)).distinct())
        again = rows.where(F.col("c") > WIDE).select("id").distinct()
        if not again.isEmpty():
            may = may.unionByName(self.compared(self.open_rows(self.exact_tiles(again)))).distinct()
        self.add(may)
        return self.member

    def compared(self, rows: DataFrame) -> DataFrame:
        """Pairs x, y of tiles (h, id, n, r, comp) across components that all bounds allow."""
        order = Window.partitionBy("id").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("before", F.collect_list("h").over(order))
        size = rows.groupBy("h").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        dealt = rows.join(size, "h").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("other", "blocks")
        cell = dealt.join(self.nodes.select("id", "bitmap"), "id")
        return cell.groupBy("h", "lo", "hi").applyInArrow(_compare, "x bigint, y bigint")


def _stars(edges: DataFrame) -> bool:
    """Whether every u has one v and no v is a u."""
    ends = edges.select(F.col("u").alias("k"), F.lit(1).alias("low"), F.lit(0).alias("top")).union(
        edges.select("v", F.lit(0), F.lit(1)))
    ends = ends.groupBy("k").agg(F.sum("low").alias("low"), F.max("top").alias("top"))
    return not ends.where("low > 1 OR low = 1 AND top = 1").count()


def connected(links: DataFrame) -> DataFrame:
    """id, comp (smallest id) of every node of the links x, y: neighbourhoods are joined to their
    smallest node, larger and smaller neighbours in turn, until all are stars."""
    edges = written(links.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "edges")
    while edges.count() and not _stars(edges):
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("u", "v", "m")
        edges = written(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                        .union(low.select("u", "m").toDF("u", "v")).distinct(), "edges")
    member = edges.select(F.col("u").alias("id"), F.col("v").alias("comp"))
    return written(member.union(member.select("comp", "comp")).distinct(), "member")


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, one row per row of docs."""
    join = _Join(docs)
    member = join.run()
    node = join.nodes.select("id", "d1", "d2", "rep").join(member, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    low = node.groupBy("comp").agg(F.min("rep").alias("component_id"))
    node = node.join(low, "comp").select("d1", "d2", "component_id")
    alone = join.sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    rest = join.sets.where("n > 0").select("doc_id", F.col("n").alias("n_shingles"), "d1", "d2")
    return rest.join(node, ["d1", "d2"]).select(*alone.columns).unionByName(alone)


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of docs with the smallest doc_id of their component, one row for each; documents
    without words are kept."""
    ship_package(docs.sparkSession)
    c = written(components(docs), "components").select(F.col("doc_id").alias("_d"), F.col("component_id").alias("_c"))
    lead = c.where(F.col("_d").eqNullSafe(F.col("_c"))).select("_d").distinct()
    kept = docs.join(lead, docs.doc_id.eqNullSafe(lead._d), "left_semi")
    # rows that repeat a doc_id: one of them, by text
    dup = kept.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_d"))
    twice = kept.join(dup, kept.doc_id.eqNullSafe(dup._d), "left_semi")
    once = kept.join(dup, kept.doc_id.eqNullSafe(dup._d), "left_anti")
    return once.unionByName(twice.dropDuplicates(["doc_id", "text"]))


def query(spark, sf_dir):
    from ratinglab.llm.common import table
    return components(table(spark, sf_dir, "documents"))
